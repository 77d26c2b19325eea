"""License scans against the wording itself."""

import random
import re
from pydoc_data.topics import topics

from inkflow.llm.license_scan import CUE, TEMPLATES, licenses, ranked, scan_licenses, _prepared

FIXED = tuple(TEMPLATES.items())


def noise(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(n))


def test_each_template_wins_and_is_confirmed():
    rng = random.Random(1)
    for name, text in FIXED:
        for body in (text, text.upper(), noise(rng, 300) + " " + text + " " + noise(rng, 300), noise(rng, 20) + "\n" + text + "\n" + noise(rng, 20)):
            got = licenses(body, FIXED)
            assert [g[0] for g in got] == [name], (name, got)
            assert got[0][2] == 0 and body[got[0][3] : got[0][4]].lower() in text.lower()


def test_compression_ranks_the_right_template_first():
    templates, plain = _prepared(FIXED)
    for name, text in FIXED:
        assert ranked(text, templates, plain)[0][1].name == name


def test_wording_decides():
    assert licenses("Licensed under the Apache License, Version 3.0.", FIXED) == []
    assert licenses("You need a licence to fish here, and permission is hereby asked.", FIXED) == []
    long = TEMPLATES["gpl-3.0-or-later"]
    assert [(g[0], g[2]) for g in licenses(long.replace("published", "issued"), FIXED)] == [("gpl-3.0-or-later", 1)]
    assert [g[0] for g in licenses("All rights reserved. Released under the MIT License.\nLicensed under CC BY 4.0.", FIXED)] == ["all-rights-reserved", "mit", "cc-by-4.0"]


def test_neighbors_are_not_taken_for_each_other():
    header = TEMPLATES["gpl-3.0-or-later"]
    old = header.replace("software:", "software;").replace("Foundation, either", "Foundation; either")
    lesser = old.replace("program", "library").replace("General", "Lesser General").replace("version 3", "version 2.1")
    cases = {
        old.replace("version 3", "version 2"): ["gpl-2.0-or-later"],
        header.replace("program", "library"): ["gpl-3.0-or-later"],
        lesser: ["lgpl-2.1-or-later"],
        lesser.replace("library", "program"): ["lgpl-2.1-or-later"],
        lesser.replace("2.1", "3"): ["lgpl-3.0-or-later"],
        lesser.replace("Lesser", "Library").replace("2.1", "2"): ["lgpl-2.0-or-later"],
        header.replace("General", "Affero General"): ["agpl-3.0-or-later"],
        header.replace("version 3", "version 4"): [],
        header.replace("GNU General", "Eclipse"): [],
        TEMPLATES["gpl-2.0"].replace("General", "Lesser General"): [],
        TEMPLATES["gpl-2.0"].replace("2.", "2.1."): [],
        TEMPLATES["gpl-2.0"].replace("2.", "2.0."): ["gpl-2.0"],
        TEMPLATES["lgpl-3.0"].replace("3.", "2.1."): ["lgpl-2.1"],
        TEMPLATES["mpl-2.0"].replace("2.0", "2.1"): [],
        TEMPLATES["mpl-2.0"].replace("Mozilla", "Eclipse"): [],
        TEMPLATES["bsd-3-clause"].replace("3", "2"): ["bsd-2-clause"],
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": ["isc-text"],
        TEMPLATES["mit-text"].replace("files, to", 'files (the "Software"), to').replace("sublicense", "sub-license"): ["mit-text"],
    }
    for text, want in cases.items():
        for body in (text, "Some words before. " + text + " And some after.", text.replace(" the ", "\n the ")):
            assert [g[0] for g in licenses(body, FIXED)] == want, body


def test_short_notices_in_long_lines_of_prose():
    rng = random.Random(4)
    prose = [w for w in " ".join(topics[k] for k in sorted(topics)).split() if re.fullmatch("[A-Za-z]+[.,]?", w) and not re.search(CUE, w)]
    for name in ("all-rights-reserved", "mit", "cc-by-4.0"):
        for size in (500, 900, 1180):
            for _ in range(50):
                at = rng.randrange(len(prose) - size)
                line = " ".join(prose[at : at + size])[:size]
                cut = line.find(" ", rng.randrange(size - 100))
                assert [g[0] for g in licenses(line[:cut] + " " + TEMPLATES[name] + line[cut:], FIXED)] == [name]


def test_cues_and_reach_come_from_the_templates(spark):
    rng = random.Random(5)
    words = noise(rng, 600).split()
    own = {"unlicense": "This is free and unencumbered software released into the public domain.", "long": " ".join(words), "grün": "Frei für alle, ÄHNLICH wie Luft."}
    edited = " ".join("x" if i % 13 == 5 else w for i, w in enumerate(words))
    rows = [(1, noise(rng, 90) + " " + own["unlicense"]), (2, noise(rng, 400) + "\n" + edited + "\n" + noise(rng, 400)), (3, edited.replace(" ", "\n")), (4, noise(rng, 400)), (5, own["grün"].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.license, r.n_blocks) for r in scan_licenses(docs, own).collect()) == [(1, "unlicense", 1), (2, "long", 1), (3, "long", 1), (5, "grün", 1)]
    assert scan_licenses(docs, {}).collect() == []
    docs = spark.createDataFrame([(1, TEMPLATES["bsd-text"].replace("Redistribution", "Distribution"))], "doc_id long, text string")
    assert [r.license for r in scan_licenses(docs).collect()] == ["bsd-text"]


def test_query_on_odd_rows(spark):
    rng = random.Random(2)
    mit, both = "é " * 50 + TEMPLATES["mit"], TEMPLATES["mit"] + "\nx\n" + TEMPLATES["mit"] + "\n" + TEMPLATES["all-rights-reserved"]
    rows = [(1, mit), (1, mit), (2, both), (3, None), (4, ""), (None, TEMPLATES["gpl-2.0"]), (5, noise(rng, 50)), (6, noise(rng, 60_000) + "\n" + TEMPLATES["apache-2.0"] + "\n" + noise(rng, 60_000))]
    docs = spark.createDataFrame([(d, t, "l", 1) for d, t in rows], "doc_id long, text string, license string, gain int")
    got = scan_licenses(docs).collect()
    assert sorted((r.doc_id or 0, r.license, r.n_blocks) for r in got) == [(0, "gpl-2.0", 1), (1, "mit", 1), (1, "mit", 1), (2, "all-rights-reserved", 1), (2, "mit", 2), (6, "apache-2.0", 1)]
    assert all(r.start == 100 for r in got if r.doc_id == 1)
    assert scan_licenses(docs.limit(0)).collect() == []
