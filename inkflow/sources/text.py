"""Plain text to blocks with columns alone; the same result as the parser of the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize, trim_space

DEFAULT_TITLE = "텍스트 문서"


def paragraphs(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, pos, text of the parts between blank lines that hold something."""
    parts = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\n{2,}", -1)).alias("pos", "_raw"))
    return parts.select(key, "pos", trim_space(sanitize(trim_space(F.col("_raw")))).alias("text")).where("text <> ''")


def text_blocks(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, pos, type, level, text, ordered, items, of all paragraphs, a title among them."""
    p = F.col("text")
    heading = r"(?U)^(#{1,6})\s+([^\n]+)$"
    lines = F.filter(F.split(p, "\n", -1), lambda x: trim_space(x) != "")
    is_list = F.forall(lines, lambda x: x.rlike(r"(?U)^\s*(?:[-*+]\s|\d+\.\s)"))
    is_heading = p.rlike(r"(?U)\A#{1,6}\s+[^\n]+\z")
    kind = F.when(is_heading, "heading").when(is_list, "list").when(p.startswith("```"), "code").otherwise("para")
    body = (
        F.when(is_heading, trim_space(F.regexp_extract(p, heading, 2)))
        .when(is_list, F.lit(None))
        .when(p.startswith("```"), trim_space(F.regexp_replace(p, r"^```[^\n]*\n?|\n?```\s*$", "")))
        .otherwise(p)
    )
    items = F.when(is_list & ~is_heading, F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s*(?:[-*+]|\d+\.)\s+", "")))
    return paragraphs(df, key, text).select(
        key,
        "pos",
        kind.alias("type"),
        F.when(is_heading, F.length(F.regexp_extract(p, heading, 1))).alias("level"),
        body.alias("text"),
        F.when(is_list & ~is_heading, F.get(lines, F.lit(0)).rlike(r"(?U)^\s*\d")).alias("ordered"),
        items.alias("items"),
    )


def text_documents(df: DataFrame, key: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """Documents (key, title) and their blocks, without the heading that became the title."""
    blocks = text_blocks(df, key, text)
    first = blocks.where("type = 'heading' and level = 1 and text <> ''").groupBy(key).agg(F.min("pos").alias("_pos"), F.min_by("text", "pos").alias("_title"))
    docs = df.select(key).join(first, key, "left").select(key, F.coalesce("_title", F.lit(DEFAULT_TITLE)).alias("title"))
    body = blocks.join(first.select(key, "_pos"), key, "left").where("_pos is null or pos <> _pos").drop("_pos")
    return docs, body
