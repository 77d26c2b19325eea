"""Greedy string tiling against brute force, and whole queries on planted passages."""

import random

import numpy as np

from inkflow.llm.decontaminate import contamination, decontaminate, parts, tiles
from inkflow.llm import decontaminate as module


def brute(item, text, least):
    """Marks the longest match again and again, as the definition says; returns how many tokens of the item are covered."""
    used_i, used_t = [False] * len(item), [False] * len(text)
    covered = 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and not used_i[p + k] and not used_t[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        k, p, t = best
        if k < least:
            return covered
        used_i[p : p + k] = [True] * k
        used_t[t : t + k] = [True] * k
        covered += k


def test_tiles_are_matches_and_cover_what_brute_force_covers():
    rng = random.Random(1)
    for trial in range(120):
        item = np.array([rng.randint(1, 60 if trial % 2 else 5) for _ in range(rng.randint(5, 45))], np.uint64)
        blocks = [item[i : i + rng.randint(3, 12)] for i in range(0, len(item), 9)]
        rng.shuffle(blocks)
        noise = [np.array([rng.randint(100, 200) for _ in range(rng.randint(0, 5))], np.uint64) for _ in blocks]
        text = np.concatenate([x for pair in zip(noise, blocks) for x in pair])
        if len(text) < 5:
            continue
        got = tiles(item, text)
        used_i, used_t = set(), set()
        for p, t, n in got:
            assert n >= 5 and (item[p : p + n] == text[t : t + n]).all()
            assert not used_i & set(range(p, p + n)) and not used_t & set(range(t, t + n))
            used_i |= set(range(p, p + n))
            used_t |= set(range(t, t + n))
        if trial % 2:  # with many different words, ties between equally long matches are rare
            assert len(used_i) == brute(item.tolist(), text.tolist(), 5)


def word_list(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def fixture(spark):
    rng = random.Random(8)
    items = [word_list(rng, 40) for _ in range(6)]
    rows = [(i, " ".join(word_list(rng, 200))) for i in range(20)]
    rows.append((100, " ".join(word_list(rng, 50) + items[0] + word_list(rng, 50))))
    moved = items[1][20:] + word_list(rng, 30) + items[1][:20]
    rows.append((101, " ".join(moved).upper().replace(" ", ", ")))
    rows.append((102, " ".join(items[2][:15] + word_list(rng, 90))))  # too little of it
    rows.append((103, " ".join(word_list(rng, 60_000) + items[3] + items[4])))
    rows += [(104, None), (105, ""), (None, " ".join(items[5])), (100, rows[20][1]), (106, "tiny one")]
    docs = spark.createDataFrame([(d, t, 0, "c") for d, t in rows], "doc_id long, text string, item_id int, coverage string")
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(20, None), (21, ""), (22, "tiny one"), (0, " ".join(items[0]))]
    return docs, spark.createDataFrame([(i, t, 5) for i, t in bench], "item_id long, text string, doc_id int")


WANT = sorted([(100, 0)] * 4 + [(101, 1), (103, 3), (103, 4), (-1, 5), (106, 22)])


def test_planted_passages(spark):
    docs, bench = fixture(spark)
    got = contamination(docs, bench).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got) == WANT
    assert all(r.contaminated and r.n_covered == r.n_item for r in got)
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), 102, 104, 105]


def test_benchmark_in_parts(spark, monkeypatch):
    docs, bench = fixture(spark)
    monkeypatch.setattr(module, "PART_BYTES", 300)
    assert len(list(parts(bench))) > 3
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in contamination(docs, bench).collect()) == WANT
    assert sorted(r.doc_id for r in decontaminate(docs, bench).collect()) == [*range(20), 102, 104, 105]


def test_empty_tables(spark):
    docs, bench = fixture(spark)
    assert contamination(docs.limit(0), bench).collect() == []
    assert contamination(docs, bench.limit(0)).collect() == []
    assert decontaminate(docs, bench.limit(0)).count() == docs.count()
