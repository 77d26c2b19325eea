"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import text_slices
from ._words import mix, shingles, words


def without_copies(texts: list[str], permutations: int = 4) -> list[int]:
    """The places of texts of which none before has one of the same smallest shingle hashes: near copies of one text would else count as so many witnesses."""
    seen: set[tuple[int, int]] = set()
    kept: list[int] = []
    place = 0
    for _, _, raw, offsets in text_slices(pa.array(texts, pa.string())):
        hashes, at = words(raw, offsets)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = shingles(hashes[a:b], 5) if b > a else np.zeros(1, np.uint64)
            keys = [(i, int(mix(own + np.uint64(i)).min())) for i in range(permutations)]
            if not any(k in seen for k in keys):
                kept.append(place)
            seen.update(keys)
            place += 1
    return kept


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, where: Column | None = None) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most per_class documents of label 1 and as many of label 0, of at most max_chars each.

    Which they are depends on a hash of doc_id alone; rows without a label or a doc_id aren't taken. The driver holds no more than
    2 * per_class texts. Of near copies within a class the first counts.
    """
    rows = labels.select("doc_id", F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(label), "doc_id")
    # twice as many ids as texts, since some are too long
    ids = [rows.where(F.col("y") == y).orderBy(order, "doc_id").limit(2 * per_class) for y in (0, 1)]
    both = F.broadcast(ids[0].unionByName(ids[1]))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_chars).join(both, "doc_id")
    got: dict[int, list] = {0: [], 1: []}
    for y in (0, 1):
        got[y] = texts.where(F.col("y") == y).select("text").orderBy(order, "doc_id", "text").limit(per_class).toLocalIterator()
        got[y] = [r.text for r in got[y]]
        got[y] = [got[y][i] for i in without_copies(got[y])]
    return got[0] + got[1], [0] * len(got[0]) + [1] * len(got[1])
