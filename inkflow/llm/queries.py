"""The queries of the operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_chunks, byte_cnn, decontaminate, exact_dedup, id_blocks, jaccard_join, license_scan, secret_scan, token_count, toxicity
from ._shared import shared_path


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"), shared_path(spark, "secret-ledger"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op5_id_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = id_blocks.write_ids(table(spark, sf_dir, "documents"), vocabulary_path())
    return id_blocks.read_digests(spark, manifest)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit_model(docs, table(spark, sf_dir, "labels")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encoding_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.quality(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_counts": op3_token_counts,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_id_blocks": op5_id_blocks,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_quality": op10_quality,
}

def _secret_oracle() -> str:
    """The spans of each rule from the lengths of matches and of the pieces between them."""
    from .secret_scan import BASE_RULES, RULES

    spans = []
    for rank, rule in enumerate(RULES):
        p = "'" + rule.pattern.replace("'", "''") + "'"
        spans.append(f"""
            SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, length(tested[i]) AS tested, {rule.least} AS least,
                   list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS s, sizes[i] AS size
            FROM (SELECT doc_id, list_transform(string_split_regex(t, {p}), lambda x: length(x)) AS gaps,
                         list_transform(regexp_extract_all(t, {p}, 0), lambda x: length(x)) AS sizes, regexp_extract_all(t, {p}, {rule.group}) AS tested
                  FROM d), unnest(range(1, len(sizes) + 1)) AS u(i)""")
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    named = "kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT"
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        spans AS ({" UNION ALL ".join(spans)}),
        found AS (SELECT doc_id, {counts}, string_agg({named}, ',' ORDER BY s, rank) FILTER (kind IN ({base})) AS base,
                         string_agg({named}, ',' ORDER BY s, rank) AS spans FROM spans WHERE tested >= least GROUP BY doc_id)
        SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN found USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": _secret_oracle(),
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 3], 'string_agg', ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS u(i)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id
        FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
