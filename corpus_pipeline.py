"""The corpus pipeline: stages over documents, each on all that its predecessor kept.

Toxic documents go; of equal texts the one with the largest doc_id stays, and of similar ones the one with the smallest; documents
that hold a benchmark passage go; what is left is encoded. SQL can't express the fitted model, the tiling or the encoding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkflow.llm import bpe_chunks, decontaminate, exact_dedup, jaccard_join, toxicity
from inkflow.llm._shared import Scratch, drop, save
from inkflow.llm.queries import table, vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit_model(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and a similarity of 0.8."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe_chunks.encoding_digests(docs, vocabulary_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; what the stages wrote before is deleted when nothing reads it any more."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with Scratch(spark) as scratch:
            done = scratch.keep(save(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            drop(spark, before)
        docs = before = done
    return docs
