"""Exact duplicates against a dictionary of texts, with keys so short that they collide."""

import hashlib
import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from inkflow.llm import exact_dedup
from inkflow.llm._shared import KeyFilter, save
from inkflow.llm.exact_dedup import build_directory, build_index, deduplicate, exact_groups, owned_rows

SCHEMA = "doc_id long, text string, key int, n string"


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for d, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(groups[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("bits,capacity", [(64, 1 << 16), (64, 4), (5, 3)])
def test_against_brute_force(spark, bits, capacity):
    rng = random.Random(bits)
    rows = [(i, f"text {rng.randint(0, 25)}" if i % 3 else "hot") for i in range(200)]
    rows += [(900, None), (901, ""), (902, "z" * 300_000), (903, "z" * 300_000), (904, "z" * 299_999 + "y"), (None, "text 1"), (None, "only null")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(5)
    assert rows_of(exact_groups(docs, bits, capacity, chain_rows=7)) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", 1, "p"), (1, "a", 2, "q"), (0, "a", 1, "p"), (2, "b", 1, "p")], SCHEMA)
    assert rows_of(exact_groups(docs)) == brute([(1, "a"), (1, "a"), (0, "a"), (2, "b")])
    assert sorted((r.doc_id, r.text) for r in deduplicate(docs).collect()) == [(1, "a"), (2, "b")]
    assert deduplicate(docs).columns == docs.columns
    none = spark.createDataFrame([], SCHEMA)
    assert exact_groups(none).collect() == []
    assert deduplicate(none).collect() == []


def test_directory_splits_overfull_buckets(spark):
    entries = spark.range(5000).selectExpr("xxhash64(cast(id as string)) AS key")
    depth, leaves = build_directory(entries, 100)
    assert sum(2 ** (depth - d) for d, _ in leaves) == 2**depth
    keys = [r.key & (1 << 64) - 1 for r in entries.collect()]
    sizes = [sum(k >> (64 - d) == p for k in keys) for d, p in leaves]
    assert max(sizes) <= 100 and sum(sizes) == 5000


def test_null_and_empty_are_one_text(spark):
    docs = spark.createDataFrame([(1, None, 1, "a"), (1, "", 2, "b"), (1, "", 3, "c"), (None, "x", 1, "d"), (None, "x", 1, "e"), (2, "y", 1, "f")], SCHEMA)
    got = sorted(((r.doc_id, r.text or "") for r in deduplicate(docs).collect()), key=str)
    assert got == [(1, ""), (2, "y"), (None, "x")]


def test_owners_go_by_the_index(spark):
    rows = [(i, f"text {i % 40}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = build_index(docs, capacity=4)
    assert index.depth > 1 and len(index.leaves) > 8
    whole = [r.link for r in owned_rows(docs, index).collect()]
    assert whole and set(whole) == {0}
    # an entry that the index lacks makes no group, and one in another bucket isn't opened by the owner that the directory names
    key = index.entries.where("n > 1").orderBy("key").first().key
    index.entries = index.entries.where(F.col("key") != key)
    assert sum(r.link < 0 for r in owned_rows(docs, index).collect()) == len([1 for r in docs.select(exact_dedup.text_key(F.col("text")).alias("k")).collect() if r.k == key])
    index.entries = index.entries.withColumn("bucket", len(index.leaves) - 1 - F.col("bucket"))
    assert sum(r.link < 0 for r in owned_rows(docs, index).collect()) > 40


def test_a_filter_of_any_keys(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id long, text string")
    index = build_index(docs)
    assert not index.filter.table.any() and owned_rows(docs, index).isEmpty()
    shared = save(docs.select(F.xxhash64("text").alias("key")).where("key % 2 = 0"), "keys")
    some = KeyFilter(shared, shared.count())
    got = docs.select(F.xxhash64("text").alias("key")).withColumn("m", some.maybe(F.col("key"))).collect()
    assert all(r.m for r in got if r.key % 2 == 0) and sum(r.m for r in got if r.key % 2) < 50
