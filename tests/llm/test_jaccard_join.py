"""The Jaccard join against all pairs, and the search by itself."""

import random
import re

import numpy as np
import pytest

from inkflow.llm._components import components
from inkflow.llm.jaccard_join import Lists, overlap, similar_groups


def shingle_set(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(x for x in (least.get(find(i)), d) if x is not None) if d is not None or least.get(find(i)) is not None else None
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(rng, n, vocabulary=3000):
    def fresh(k):
        return [f"w{rng.randint(0, vocabulary)}" for _ in range(k)]

    passage, rows = fresh(40), []
    bases = [fresh(rng.choice([5, 12, 30, 80, 200])) for _ in range(12)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            text = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 50)}"
        elif kind < 0.75:
            text = fresh(rng.randint(0, 30)) + passage + fresh(rng.randint(0, 30))
        else:
            text = fresh(rng.randint(0, 8))
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("block,search_block", [(4000, 256), (5, 3)])
def test_against_all_pairs(spark, block, search_block):
    rng = random.Random(block)
    rows = corpus(rng, 260)
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One Two three"), (1004, "one two THREE"), (1005, "one two three four"), (0, rows[0][1]), (7, "another text for a doc_id that is there already"), (None, rows[5][1]), (None, "one two three"), (None, "only rows without an id say these very words here"), (None, "Only rows without an id say these very words here"), (None, "only rows without an id say these very words here " + "and more " * 40), (None, "only rows without an id say these very words here " + "and more " * 41), (1006, "A B ÄÖ"), (1007, "a b ÄÖ"), (1008, "long words here " * 9000), (1009, "long words here " * 8999)]
    docs = spark.createDataFrame([(d, t, b"x", 1) for d, t in rows], "doc_id long, text string, node binary, n int").repartition(4)
    got = similar_groups(docs, block=block, search_block=search_block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_search_equals_counting():
    rng = np.random.default_rng(3)
    for n in (1, 3, 10, 60, 300):
        query = np.unique(rng.integers(0, 10**6, n).astype(np.uint64))
        candidates = []
        for _ in range(80):
            keep = query[rng.random(len(query)) < rng.choice([0.5, 0.8, 0.95, 1.0])]
            candidates.append(np.unique(np.concatenate([keep, rng.integers(0, 10**6, rng.integers(0, 1 + n // 8)).astype(np.uint64)])))
        lists = Lists(candidates)
        for q in [query, *candidates]:
            want = [i for i, c in enumerate(candidates) if len(c) and len(np.intersect1d(q, c)) >= overlap(len(q), len(c), 85)] if len(q) else []
            assert lists.search(q, 85) == want
            assert lists.search(q, 85, mu=5) == want
    assert Lists([]).search(query, 85) == [] and Lists(candidates).search(query[:0], 85) == []


def test_search_merges_few_lists(monkeypatch):
    rng = np.random.default_rng(8)
    query = np.unique(rng.integers(0, 10**9, 400).astype(np.uint64))
    lists = Lists([np.unique(np.concatenate([query[i % 9 :], rng.integers(0, 10**9, 5).astype(np.uint64)])) for i in range(100)])
    merged, probed = [], []
    own_merge, own_probe = Lists._merged, Lists._probe
    monkeypatch.setattr(Lists, "_merged", lambda self, short, least: (merged.append(len(short)), own_merge(self, short, least))[1])
    monkeypatch.setattr(Lists, "_probe", lambda self, long, place: (probed.append(len(long)), own_probe(self, long, place))[1])
    assert len(lists.search(query, 85)) == 100
    assert merged[0] < 100 and set(probed) == {len(query) - merged[0]}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        root.setdefault(a, a)
        root.setdefault(b, b)
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def test_empty_table(spark):
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
