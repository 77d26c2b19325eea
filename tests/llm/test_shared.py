"""What the operators share: slices, word hashes, joins with large groups, samples, components of near copies."""

import os
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkflow.llm._sample import without_copies
from inkflow.llm._shared import Scratch, drop, join_groups, save, shared_folder, text_slices
from inkflow.llm._words import BARE, shingles, spans, words

TEXTS = st.lists(st.text(alphabet=st.sampled_from("aAbB \t\n\r.,é漢🙂0"), max_size=30), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_slices_hold_all_texts(texts, limit):
    got = []
    for i, j, raw, offsets in text_slices(pa.chunked_array([texts[:5], texts[5:]], pa.string()), limit):
        assert i == len(got)
        data = raw.tobytes()
        got += [data[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
        assert j == len(got)
    assert got == texts


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_word_hashes_are_equal_when_words_are(texts, limit):
    for table, pattern in ((None, r"[^\x20\x09-\x0d]+"), (BARE, r"[0-9A-Za-z\x80-\U0010ffff]+")):
        seen: dict[str, int] = {}
        for _, _, raw, offsets in text_slices(pa.array(texts, pa.string())):
            kind = {} if table is None else {"is_word": table}
            hashes, at = words(raw, offsets, limit=limit, **kind)
            assert sum(len(s) for _, _, s, _ in spans(raw, offsets, limit=limit, **kind)) == len(hashes)
            for t, a, b in zip(texts, at[:-1], at[1:]):
                own = [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(pattern, t)]
                assert len(own) == b - a
                for w, h in zip(own, hashes[a:b].tolist()):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_shingles():
    h = np.arange(1, 9, dtype=np.uint64)
    assert len(shingles(h, 4)) == 5 and len(shingles(h[:3], 4)) == 1 and len(shingles(h[:0], 4)) == 0
    assert shingles(h, 4)[2] == shingles(h[2:6], 4)[0] and shingles(h[:3], 4)[0] not in shingles(h, 4)


def test_join_with_large_groups(spark):
    rows = spark.range(6000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id") % 50).alias("k"))
    groups = save(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top")).where("k <> 7"), "groups")
    for how in ("inner", "left"):
        got, want = join_groups(rows, groups, ["k"], "n", 6000, how), rows.join(groups, ["k"], how)
        assert "Broadcast" in got._jdf.queryExecution().executedPlan().toString()
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    drop(spark, groups)


def test_saved_tables(spark):
    assert shared_folder(spark) == shared_folder(spark)
    table = save(spark.range(5).withColumn("p", F.col("id") % 2), "x", ["p"])
    assert sorted(map(tuple, table.collect())) == [(i, i % 2) for i in range(5)]
    empty = save(spark.range(0), "y")
    assert empty.count() == 0
    drop(spark, table, empty)


def test_scratch_tables_go(spark):
    with Scratch(spark) as outer:
        with Scratch(spark) as inner:
            gone, kept = save(spark.range(3), "gone"), inner.keep(save(spark.range(4), "kept"))
            files = gone.inputFiles()
        assert kept.count() == 4 and not any(os.path.exists(f.split(":", 1)[-1].replace("///", "/")) for f in files)
        outer.keep(kept)
    assert kept.count() == 4


def test_near_copies_are_one_witness():
    rng = random.Random(1)
    base = [" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(60)) for _ in range(10)]
    texts = [b + f" edit{k}" for b in base for k in range(5)] + [""]
    assert without_copies(texts) == [*range(0, 50, 5), 50]
