"""Lookups, integrity checks and aggregates over flat document tables. Keys always include the document, so every join is an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import line_count


def look_up(df: DataFrame, table: DataFrame, on: list[str], value: str, default: Column, name: str) -> DataFrame:
    """df with a value of table (one row a key), or default where there is none."""
    found = table.select(*on, F.col(value).alias("_found"))
    return df.join(found, on, "left").withColumn(name, F.coalesce("_found", default)).drop("_found")


def look_up_chain(df: DataFrame, steps: list[tuple[DataFrame, str, str]], start: str, name: str) -> DataFrame:
    """Follows keys from table to table: (table, its key, its value); null where the chain breaks."""
    out = df.withColumn("_key", F.col(start))
    for table, key, value in steps:
        out = out.join(table.select(F.col(key).alias("_key"), F.col(value).alias("_next")), "_key", "left").drop("_key").withColumnRenamed("_next", "_key")
    return out.withColumnRenamed("_key", name)


def dangling(used: DataFrame, defined: DataFrame, on: list[str]) -> DataFrame:
    """Distinct references to nothing."""
    return used.select(*on).distinct().join(defined.select(*on), on, "left_anti")


def unpaired(begins: DataFrame, ends: DataFrame, on: list[str]) -> DataFrame:
    """Keys whose numbers of begins and ends differ, with both."""
    one = begins.groupBy(*on).agg(F.count(F.lit(1)).alias("n_begin"))
    two = ends.groupBy(*on).agg(F.count(F.lit(1)).alias("n_end"))
    both = one.join(two, on, "full").select(*on, F.coalesce("n_begin", F.lit(0)).alias("n_begin"), F.coalesce("n_end", F.lit(0)).alias("n_end"))
    return both.where("n_begin <> n_end")


def broken_chain(refs: DataFrame, steps: list[tuple[str, DataFrame]], on: list[str]) -> DataFrame:
    """References that some table along the way lacks, with the name of the first such table."""
    out, missing = refs.select(*on).distinct(), None
    for name, table in steps:
        out = out.join(table.select(*on).distinct().withColumn(f"_{name}", F.lit(True)), on, "left")
        missing = F.when(F.col(f"_{name}").isNull(), name) if missing is None else missing.when(F.col(f"_{name}").isNull(), name)
    return out.select(*on, missing.alias("missing_in")).where("missing_in is not null")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side; empty when both are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


KINDS = {"n_heading": ("heading",), "n_para": ("para",), "n_list": ("list",), "n_table": ("table",), "n_code": ("code",), "n_quote": ("quote",), "n_image": ("image", "image-source"), "n_blank": ("blank",)}


def summary_of(parsed: DataFrame, key: str) -> DataFrame:
    """summary() of parsed structs (column doc), row by row."""
    doc = F.col("doc")

    def count(names: tuple[str, ...]) -> Column:
        return F.size(F.filter(doc["blocks"], lambda b: (b["depth"] == 0) & b["type"].isin(*names))).cast("long")

    titled = F.when(F.coalesce(doc["title"], F.lit("")) != "", 1).otherwise(0)
    return parsed.select(key, doc["title"].alias("title"), titled.alias("n_title"), *(count(names).alias(n) for n, names in KINDS.items()))


def summary(blocks: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Counts of top-level blocks by kind, and whether there is a title."""
    top = F.col("depth") == 0
    kinds = {n: F.col("type").isin(*names) for n, names in KINDS.items()}
    counts = blocks.groupBy(key).agg(*(F.count_if(top & test).alias(name) for name, test in kinds.items()))
    titled = docs.select(key, "title", F.when(F.coalesce("title", F.lit("")) != "", 1).otherwise(0).alias("n_title"))
    return titled.join(counts, key, "left").select(key, "title", "n_title", *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in kinds))


def code_audit(blocks: DataFrame, key: str) -> DataFrame:
    """Code blocks of all depths: their number and lines."""
    code = blocks.where(F.col("type") == "code")
    return code.groupBy(key).agg(F.count(F.lit(1)).alias("block_count"), F.sum(line_count(F.coalesce("text", F.lit("")))).alias("line_count"))


def code_edges(blocks: DataFrame, key: str) -> DataFrame:
    """First and last line of every code block."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return blocks.where(F.col("type") == "code").select(key, "block_id", F.size(lines).alias("line_count"), F.element_at(lines, 1).alias("first_line"), F.element_at(lines, -1).alias("last_line"))


def audit_mismatches(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Documents whose code audits differ."""
    b, a = (x.select(key, *(F.col(c).alias(f"{c}_{side}") for c in ("block_count", "line_count"))) for x, side in ((before, "before"), (after, "after")))
    both = b.join(a, key, "full").na.fill(0)
    return both.where("block_count_before <> block_count_after or line_count_before <> line_count_after")


def key_union(df: DataFrame, keys: list[str], order: str, json: Column) -> DataFrame:
    """The keys of JSON objects in the order they are first seen: keys, field, pos."""
    names = df.select(*keys, F.col(order).alias("_o"), F.posexplode(F.json_object_keys(json)).alias("_p", "field"))
    first = names.groupBy(*keys, "field").agg(F.min(F.struct("_o", "_p")).alias("_first"))

    return first.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1).drop("_first")


def joined_text(df: DataFrame, keys: list[str], order: str, text: str, separator: str) -> DataFrame:
    """The texts of each key, in order, as one."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator).alias(text))


def status_counts(df: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """done (with warnings as well), warn, error and other results."""
    s = F.col(status)
    return df.groupBy(*keys).agg(F.count_if(s.isin("done", "warn")).alias("n_done"), F.count_if(s == "warn").alias("n_warn"), F.count_if(s == "error").alias("n_error"), F.count_if(~s.isin("done", "warn", "error")).alias("n_other"), F.count(F.lit(1)).alias("n"))


def count_mismatches(declared: DataFrame, members: DataFrame, on: list[str], count: str) -> DataFrame:
    """Groups whose declared number of members isn't the actual one."""
    actual = members.groupBy(*on).agg(F.count(F.lit(1)).alias("actual"))
    both = declared.join(actual, on, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.where(F.col(count) != F.col("actual")).select(*on, count, "actual")


def weighted_score(df: DataFrame, weights: dict[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())
