"""License scans by conditional compression.

A line of a text that has a cue, with the lines around it as far as the longest template and its tolerance, is a candidate block. Cues
come from the templates: all words of one that allows no differences, or words of which a stretch that holds the template has at
least one. A block is compressed with zstandard by itself and with each template as a raw dictionary, which ranks the templates by what they take off its
size. The words of each are then compared, whatever its rank, since a long block hides a short notice from the compressor: the template
must stand in the block but for at most TOLERANCE of its words (at least none), and what tells licenses apart must agree: a stretch
holds the template's names, numbers and versions in their order and no other ones (so a GNU license that is Lesser, Affero or of
another version is not taken for its neighbor, and a number put into a notice makes it none), and the words by which the template
differs from others so like it that a text may be close to both. A confirmed stretch is cut out and what is left is ranked again, so a block may hold several licenses.

Rows are independent, so there is no shuffle; texts without a cue never leave the JVM.

Defined results: one row for each document and license; none for documents without one, with a null or empty text. Repeated
rows each give rows; a null doc_id stays null; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import texts

LEVEL = 3
#: Share of a template's words that may be missing or different.
TOLERANCE = 0.1
SCHEMA = "doc_id long, license string, n_blocks int, gain double, n_different int, start long, end long"

# Notices by which licenses are declared.
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-2.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "bsd-2-clause": "Released under the BSD 2-Clause License.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
}
#: Words; a version is one, and 2.0 is 2.
_WORD = re.compile(r"\d+(?:\.\d+)*\b|\w+")
_ZEROS = re.compile(r"(?:\.0+)+$")
#: Words that name licenses, beside all with a digit; "library" only after "gnu", since any program may be one.
NAMES = frozenset(
    "gnu general public lesser affero gpl lgpl agpl gfdl apache mit x11 isc bsd mozilla mpl cc nc nd sa clause eclipse epl cddl boost artistic academic zlib unlicense wtfpl eupl".split()
)
#: Names that are everyday words too, so poor cues.
EVERYDAY = frozenset("general public clause academic artistic boost".split())
#: Characters around a cue that a block takes in at most, on either side, unless the longest template needs more.
REACH = 600


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    telling: frozenset[str]
    compressor: zstandard.ZstdCompressor


def normal(word: str) -> str:
    """A word as it is compared."""
    return _ZEROS.sub("", word.lower())


def marks(words: Sequence[str]) -> tuple[str, ...]:
    """The names, numbers and versions among words, in their order."""
    return tuple(w for i, w in enumerate(words) if w in NAMES or any(c.isdigit() for c in w) or (w == "library" and i and words[i - 1] == "gnu"))


def _slack(words: Sequence[str]) -> int:
    return int(TOLERANCE * len(words))


def _telling(words: tuple[str, ...], others: list[tuple[str, ...]]) -> frozenset[str]:
    """The marks, and what a template of which a text may be as close lacks."""
    telling = set(marks(words))
    for other in others:
        same = sum(m.size for m in SequenceMatcher(None, words, other, autojunk=False).get_matching_blocks())
        if max(len(words), len(other)) - same <= _slack(words) + _slack(other):
            telling |= set(words) - set(other)
    return frozenset(telling)


@cache
def _prepared(templates: tuple[tuple[str, str], ...]) -> tuple[list[Template], zstandard.ZstdCompressor]:
    split = {name: tuple(normal(w) for w in _WORD.findall(text)) for name, text in templates}
    out = []
    for name, text in templates:
        telling = _telling(split[name], [other for other in split.values() if other != split[name]])
        words = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(Template(name, split[name], telling, zstandard.ZstdCompressor(level=LEVEL, dict_data=words)))
    return out, zstandard.ZstdCompressor(level=LEVEL)


def anchors(template: Template) -> list[str]:
    """Words of which a stretch that holds the template has at least one: a telling word, which must be there; of others, one more than may be missing."""
    rare = sorted(set(template.words), key=lambda w: (w not in template.telling, w in EVERYDAY or w[0].isdigit(), -len(w), w))
    return rare[: 1 if template.telling else _slack(template.words) + 1]


@cache
def cue(templates: tuple[tuple[str, str], ...]) -> str:
    """An expression, for Java and Python, that is found in each text that holds a template."""

    def form(word: str) -> str:
        return re.escape(word) + (r"(?:\.0+)*" if word[0].isdigit() else "")

    found = set()
    for t in _prepared(templates)[0]:
        if _slack(t.words):
            found |= {form(w) + "(?![0-9A-Za-z_])" for w in anchors(t)}
        elif t.words:
            found.add(r"\W+".join(map(form, t.words)))
    return "(?iu)(?<![0-9A-Za-z_])(?:" + "|".join(sorted(found)) + ")" if found else "(?!)"


CUE = cue(tuple(TEMPLATES.items()))


def blocks(text: str, cues: re.Pattern[str], n_words: int, reach: int = REACH) -> list[tuple[int, int]]:
    """Stretches around cues: to the ends of the line, or of the lines around as far as reach, but with n_words words on either side."""
    out: list[tuple[int, int]] = []

    def enough(lo: int, hi: int) -> bool:
        return sum(1 for _ in _WORD.finditer(text, lo, hi)) >= n_words

    for m in cues.finditer(text):
        far = reach
        while True:
            if a := max(0, m.start() - far):
                a = next((i + 1 for i in (text.find("\n", a, m.start()), text.find(" ", a, m.start())) if i >= 0 and enough(i + 1, m.start())), -1)
            if a >= 0:
                break
            far *= 2
        far = reach
        while True:
            if (b := min(len(text), m.end() + far)) < len(text):
                b = next((i for i in (text.rfind("\n", m.end(), b), text.rfind(" ", m.end(), b)) if i >= 0 and enough(m.end(), i)), -1)
            if b >= 0:
                break
            far *= 2
        if out and a <= out[-1][1]:
            out[-1] = (min(a, out[-1][0]), max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def ranked(block: str, templates: list[Template], plain: zstandard.ZstdCompressor) -> list[tuple[float, Template]]:
    """Templates by the share of the block's compressed size that they take off, the largest first."""
    data = block.lower().encode()
    alone = len(plain.compress(data))
    gains = [((alone - len(t.compressor.compress(data))) / alone, t) for t in templates]
    return sorted(gains, key=lambda g: (-g[0], g[1].name))


def wording(template: Template, words: list[str]) -> tuple[int, int, int] | None:
    """The first and end word of the stretch that holds the template, and how many words differ; None if it isn't there."""
    best = None
    n = len(template.words)
    slack, own_marks = _slack(template.words), marks(template.words)
    first = {w: template.words.index(w) for w in anchors(template)}
    for i, w in enumerate(words):
        if w not in first:
            continue
        offset = first[w]
        a, b = max(0, i - offset - slack), min(len(words), i - offset + n + slack)
        own = words[a:b]
        found = [m for m in SequenceMatcher(None, template.words, own, autojunk=False).get_matching_blocks() if m.size]
        if not found:
            continue
        lo, hi = found[0].b, found[-1].b + found[-1].size
        differ = max(n, hi - lo) - sum(m.size for m in found)
        if differ <= slack and template.telling <= set(own[lo:hi]) and marks(own[lo:hi]) == own_marks and (best is None or differ < best[2]):
            best = (a + lo, a + hi, differ)
    return best


def licenses(text: str, templates: tuple[tuple[str, str], ...]) -> list[tuple[str, float, int, int, int]]:
    """License, gain, words that differ, start and end of every confirmed stretch of the text."""
    prepared, plain = _prepared(templates)
    cues = re.compile(cue(templates))
    n_words = max((len(t.words) + _slack(t.words) for t in prepared), default=0)
    out = []
    for a, b in blocks(text, cues, n_words):
        # each cue's line by itself first, so that the gain is that line's
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            stretch = text[x:y]
            if not cues.search(stretch):
                continue
            lines = [(x + m.start(), x + m.end()) for m in re.finditer(r"[^\n]+", stretch)]
            hit = None
            for lo, hi in [*(l for l in lines if cues.search(text, *l)), (x, y)]:
                spans = list(_WORD.finditer(text, lo, hi))
                words = [normal(m.group()) for m in spans]
                confirmed = []
                for gain, t in ranked(text[lo:hi], prepared, plain):
                    if got := wording(t, words):
                        confirmed.append((-len(t.words), got[2], t.name, gain, spans[got[0]].start(), spans[got[1] - 1].end()))
                if confirmed:
                    # of templates that all stand there, the longest says most
                    _, differ, name, gain, s, e = min(confirmed)
                    hit = (name, gain, differ, s, e)
                    break
            if hit:
                out.append(hit)
                todo += [(x, hit[3]), (hit[4], y)]
    return sorted(out, key=lambda h: h[3])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, its number of confirmed stretches, the best one's gain, words that differ, start and end (code points)."""
    fixed = tuple((TEMPLATES if templates is None else templates).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                by_name: dict[str, list] = {}
                for name, gain, differ, s, e in licenses(text, fixed):
                    by_name.setdefault(name, []).append((differ, -gain, s, e))
                for name, hits in by_name.items():
                    differ, gain, s, e = min(hits)
                    rows.append((doc_id, name, len(hits), -gain, differ, s, e))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "license", "n_blocks", "gain", "n_different", "start", "end"])

    return texts(docs).where(F.col("text").rlike(cue(fixed))).mapInArrow(run, SCHEMA)
