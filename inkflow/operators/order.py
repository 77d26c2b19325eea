"""Operators that depend on the order of rows within a document: islands, numbering, spacers, titles, dictionaries, quotas, names.

Every table carries its order as a column. Each operator shuffles once, on the document's key (and what it is ordered within); none
gathers more than one document, and those that only look at neighbours stream over a sorted partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window, WindowSpec

from ..functions.text import block_text, is_generic_title, title_candidate


def _within(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "island") -> DataFrame:
    """Numbers runs of neighbouring rows with the same value, from 1 within each key; nulls are a value of their own."""
    w = _within(keys, order)
    marked = df.withColumn("_value", value)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.lag("_value").over(w).eqNullSafe(F.col("_value")), 0).otherwise(1)
    return marked.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_value", "_new")


def grouped_runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One row a run: keys, island, value, first, last and number of rows."""
    out = islands(df, keys, [order], F.col(value))
    return out.groupBy(*keys, "island").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def level_markers(df: DataFrame, keys: list[str], order: str, level: str = "level", ordered: str = "ordered", start: Column | None = None) -> DataFrame:
    """Numbers list items level by level: an ordered item ends the counts of deeper levels, an unordered one its own level's.

    Adds marker, null for unordered items. The number of an item is how many ordered items of its level follow the last row that
    ended its count: any ordered row of a smaller level, or an unordered row of its own. Levels may be of any depth.
    """

    def step(counts: tuple[tuple[int, int], ...], x: dict) -> tuple[tuple[tuple[int, int], ...], int | None]:
        lv = x["level"]
        if lv is None or x["ordered"] is None:
            return counts, None
        if not x["ordered"]:
            return tuple(c for c in counts if c[0] != lv), None
        n = dict(counts).get(lv, 0) + 1
        return (*(c for c in counts if c[0] < lv), (lv, n)), n

    item = F.struct(F.col(level).alias("level"), F.col(ordered).alias("ordered"))
    out = _folded(df.withColumn("_item", item), keys, [order], "_item", "marker", "int", step, ()).drop("_item")
    return out if start is None else out.withColumn("marker", F.col("marker") + start - 1)


def without_spacers(df: DataFrame, keys: list[str], order: str, kind: str = "type") -> DataFrame:
    """Without blank rows whose nearest row that isn't blank, on either side, is a rule."""
    w = _within(keys, [order])
    shown = F.when(F.col(kind) != "blank", F.col(kind))
    before = F.last(shown, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(shown, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    drop = (F.col(kind) == "blank") & (before.eqNullSafe("hr") | after.eqNullSafe("hr"))
    return df.withColumn("_drop", F.coalesce(drop, F.lit(False))).where(~F.col("_drop")).drop("_drop")


def first_headings(blocks: DataFrame, key: str) -> DataFrame:
    """The first top-level heading of level 1 of each document: key, pos, text."""
    top = blocks.where((F.col("depth") == 0) & (F.col("type") == "heading") & (F.col("level") == 1))
    return top.groupBy(key).agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))


def first_candidates(blocks: DataFrame, key: str) -> DataFrame:
    """The first heading or paragraph whose text could be a title: key, pos, type, text."""
    text = block_text(F.col("text"), F.col("runs")) if "runs" in blocks.columns else title_candidate(F.col("text"))
    named = blocks.where((F.col("depth") == 0) & F.col("type").isin("heading", "para")).withColumn("_text", text)
    named = named.where((F.col("_text") != "") & ~is_generic_title(F.col("_text")))
    return named.groupBy(key).agg(F.min("pos").alias("pos"), F.min_by("type", "pos").alias("type"), F.min_by("_text", "pos").alias("text"))


def titles(docs: DataFrame, blocks: DataFrame, key: str, custom: Column, source: Column) -> DataFrame:
    """key, title, title_source: what was asked for, else the file's name where source is 'filename', else a parsed title that says something
    (unless the format is docx), else the first candidate in the body, else the parsed one, else the file's name.

    docs has title, ext and file_base.
    """
    firsts = first_candidates(blocks, key).select(key, F.col("text").alias("_first"))
    d = docs.join(firsts, key, "left")
    asked, parsed, base = title_candidate(custom), title_candidate(F.col("title")), F.coalesce("file_base", F.lit(""))
    good = (parsed != "") & ~is_generic_title(parsed)
    cases = [(asked != "", "custom", asked), (source == "filename", "filename", base), ((F.col("ext") != "docx") & good, "parsed", parsed), (F.col("_first").isNotNull(), "first", F.col("_first")), (good, "parsed", parsed)]
    title = kind = None
    for test, name, value in cases:
        title = F.when(test, value) if title is None else title.when(test, value)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return d.select(key, title.otherwise(base).alias("title"), kind.otherwise("filename").alias("title_source"))


def body_with_title_policy(blocks: DataFrame, titled: DataFrame, docs: DataFrame, key: str, keep: bool = False) -> DataFrame:
    """Blocks after the policy: the first top-level heading that says the title leaves the body, unless kept; a parsed title that another one
    replaced comes back as a heading in front (pos -1), unless the body has its text already."""
    text = block_text(F.col("text"), F.col("runs"))
    b = blocks.join(titled, key, "left").withColumn("_text", text)
    top = F.col("depth") == 0
    says = top & (F.col("type") == "heading") & (F.col("_text") == F.col("title")) & F.col("title_source").isin("parsed", "first")
    w = Window.partitionBy(key)
    if not keep:
        gone = F.min(F.when(says, F.col("pos"))).over(w)
        root = F.split("block_id", r"\.").getItem(0).cast("int")
        b = b.withColumn("_gone", gone).where(F.col("_gone").isNull() | (root != F.col("_gone"))).drop("_gone")
    body = b.drop("title", "title_source", "_text")
    lost = docs.select(key, title_candidate(F.col("title")).alias("_parsed")).join(titled.where(F.col("title_source").isin("custom", "filename")), key)
    lost = lost.where((F.col("_parsed") != "") & (F.col("_parsed") != title_candidate(F.col("title"))))
    there = b.where(top).select(key, F.col("_text").alias("_parsed")).distinct()
    lost = lost.join(there, [key, "_parsed"], "left_anti")
    front = {"block_id": F.lit("-1"), "depth": F.lit(0), "pos": F.lit(-1), "type": F.lit("heading"), "level": F.lit(1), "text": F.col("_parsed")}
    restored = lost.select(key, *(front.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in body.schema.fields if f.name != key))
    return body.unionByName(restored.select(*body.columns))


def dictionary_ids(df: DataFrame, keys: list[str], order: list[str], signature: Column, first_id: int) -> DataFrame:
    """Distinct signatures with ids in order of first appearance, from first_id: keys, signature, id."""
    seen = df.withColumn("signature", signature).where("signature is not null").groupBy(*keys, "signature").agg(F.min(F.struct(*order)).alias("_first"))
    return seen.withColumn("id", F.row_number().over(_within(keys, ["_first"])) + first_id - 1).drop("_first")


def border_variants(colours: DataFrame, keys: list[str], first_id: int = 20) -> DataFrame:
    """Four border fills for each background in colours (keys, colour, order), one after the other: keys, colour, side, id."""
    ranked = colours.withColumn("_n", F.row_number().over(_within(keys, ["order"])) - 1)
    return ranked.select(*keys, "colour", "_n", F.posexplode(F.array(*map(F.lit, ("full", "left", "right", "both")))).alias("_k", "side")).select(*keys, "colour", "side", (F.col("_n") * 4 + F.col("_k") + first_id).alias("id"))


def running_ids(df: DataFrame, keys: list[str], order: list[str], start: int = 0, name: str = "id") -> DataFrame:
    return df.withColumn(name, F.row_number().over(_within(keys, order)) - 1 + start)


def list_numbers(df: DataFrame, keys: list[str], order: str, wanted: Column, name: str = "number") -> DataFrame:
    """Counts the rows that want a number, in order; null for the others."""
    w = _within(keys, [order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.when(wanted, F.sum(wanted.cast("int")).over(w)))


def logical_columns(df: DataFrame, keys: list[str], order: str, span: str = "col_span") -> DataFrame:
    """The first grid column of each cell of a row: the spans before it."""
    w = _within(keys, [order]).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("col", F.coalesce(F.sum(span).over(w), F.lit(0)))


def _folded(df: DataFrame, keys: list[str], order: list[str], size: str, name: str, kind: str, step: Callable[[Any, int | None], tuple[Any, Any]], start: Any) -> DataFrame:
    """Adds a column that depends on all rows of a key before: a state goes from row to row, as they stream by in order.

    A key's rows pass through one task, since each needs the state of the last, but none is held; there must be a key, so that not all rows do.
    """
    if not keys:
        raise ValueError("a state that goes through a whole table needs a key to deal it by")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    out_type = to_arrow_type(T._parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), start
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            made = []
            for key, x in zip(own, batch.column(size).to_pylist()):
                if key != last:
                    last, state = key, start
                state, value = step(state, x)
                made.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, out_type)], [*batch.schema.names, name])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order, size).mapInArrow(run, schema)


def greedy_quota(df: DataFrame, keys: list[str], order: str, size: str, each: int, total: int) -> DataFrame:
    """Adds accepted: rows are taken in order while they fit; one that doesn't, or that has no size, uses up nothing."""

    def step(used: int, x: int | None) -> tuple[int, bool]:
        fits = x is not None and x <= each and used + x <= total
        return used + (x if fits else 0), fits

    return _folded(df, keys, [order], size, "accepted", "boolean", step, 0)


def unique_names(df: DataFrame, keys: list[str], order: list[str], name: str = "name") -> DataFrame:
    """Adds unique_name: the first of equal names as it is, the next with ' (2)' before the extension, and so on; a number that another name has already is passed over.

    Only names that are alike but for such numbers can meet; where one of these has a number of its own, they are named one after the other, else by a count.
    """
    parts = r"^(.*?)(\.[^.]*)?$"
    stem, ext = F.regexp_extract(name, parts, 1), F.regexp_extract(name, parts, 2)
    root = F.regexp_replace(stem, r"( \(\d+\))+$", "")
    alike = df.withColumn("_root", F.concat_ws("\0", root, ext))
    numbered = F.max(stem != root).over(Window.partitionBy(*keys, "_root"))
    marked = alike.withColumn("_numbered", F.coalesce(numbered, F.lit(False)))
    n = F.row_number().over(_within([*keys, name], order))
    counted = marked.where(~F.col("_numbered")).withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext)))

    def step(used: dict[str, int] | None, x: str | None) -> tuple[dict[str, int], str | None]:
        used = {} if used is None else used
        if x is None:
            return used, None
        if x not in used:
            used[x] = 1
            return used, x
        base, dot, last = x.rpartition(".")
        base, tail = (base, dot + last) if dot else (x, "")
        i = used[x] + 1
        while f"{base} ({i}){tail}" in used:
            i += 1
        used[x] = i
        used[f"{base} ({i}){tail}"] = 1
        return used, f"{base} ({i}){tail}"

    folded = _folded(marked.where("_numbered"), [*keys, "_root"], order, name, "unique_name", "string", step, None)
    return counted.unionByName(folded).drop("_root", "_numbered")


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key, and overflow: how many more there are."""
    w = _within(keys, order)
    counted = df.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.where(F.col("_n") <= n).withColumn("overflow", F.greatest(F.col("_all") - n, F.lit(0))).drop("_n", "_all")


def paginate(df: DataFrame, keys: list[str], order: str, height: str, page: int) -> DataFrame:
    """Adds page: rows fill pages of a height greedily; a row taller than a page has one to itself."""

    def step(state: tuple[int, int], x: int | None) -> tuple[tuple[int, int], int]:
        used, n = state
        x = x or 0
        if used and used + x > page:
            used, n = 0, n + 1
        return (used + x, n), n

    return _folded(df, keys, [order], height, "page", "int", step, (0, 0))
