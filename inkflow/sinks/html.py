"""Blocks to HTML, with columns alone: each block's markup is an expression over its runs, items or cells, and blocks are joined in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import html_escape
from ..functions.values import has_safe_scheme


def _wrapped(test: Column, tag: str, inner: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))).otherwise(inner)


def run_html(r: Column) -> Column:
    out = F.replace(html_escape(F.coalesce(r["text"], F.lit(""))), F.lit("\n"), F.lit("<br>"))
    for key, tag in (("code", "code"), ("bold", "strong"), ("italic", "em"), ("underline", "u"), ("strike", "s")):
        out = _wrapped(r[key], tag, out)
    out = F.when(F.coalesce(r["color"], F.lit("")) != "", F.concat(F.lit('<span style="color:'), html_escape(r["color"]), F.lit('">'), out, F.lit("</span>"))).otherwise(out)
    out = F.when(F.coalesce(has_safe_scheme(r["href"]), F.lit(False)), F.concat(F.lit('<a href="'), html_escape(r["href"]), F.lit('">'), out, F.lit("</a>"))).otherwise(out)
    return F.when(F.coalesce(r["footnote"], F.lit("")) != "", F.concat(out, F.lit("<sup>"), html_escape(r["footnote"]), F.lit("</sup>"))).otherwise(out)


def runs_html(runs: Column, text: Column) -> Column:
    """The runs' markup, or the text's where there are none."""
    plain = F.replace(html_escape(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit("<br>"))
    return F.when(runs.isNotNull() & (F.size(runs) > 0), F.array_join(F.transform(runs, run_html), "")).otherwise(plain)


def _ordered(df: DataFrame, keys: list[str], order: str, html: Column, name: str) -> DataFrame:
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), html.alias("h"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda x: x["h"]), "").alias(name))


def lists_html(items: DataFrame, key: str) -> DataFrame:
    """key, block_id, html of each list; nested levels open and close as far as they differ from the neighbours'."""
    w = Window.partitionBy(key, "block_id").orderBy("pos")
    before = F.coalesce(F.lag("level").over(w), F.lit(-1))
    after = F.coalesce(F.lead("level").over(w), F.lit(-1))
    tag = F.when(F.col("ordered"), "ol").otherwise("ul")
    box = F.when(F.col("task"), F.when(F.col("checked"), "☑ ").otherwise("☐ ")).otherwise("")
    opened = F.repeat(F.concat(F.lit("<"), tag, F.lit(">")), F.greatest(F.col("level") - before, F.lit(0)))
    closed = F.repeat(F.concat(F.lit("</"), tag, F.lit(">")), F.greatest(F.col("level") - after, F.lit(0)))
    each = items.withColumn("_html", F.concat(opened, F.lit("<li>"), box, runs_html(F.col("runs"), F.col("text")), F.lit("</li>"), closed))
    return _ordered(each, [key, "block_id"], "pos", F.col("_html"), "html")


def tables_html(cells: DataFrame, key: str) -> DataFrame:
    def span(name: str, c: str) -> Column:
        return F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")

    tag = F.when(F.col("is_header"), "th").otherwise("td")
    one = F.concat(F.lit("<"), tag, span("colspan", "col_span"), span("rowspan", "row_span"), F.lit(">"), runs_html(F.col("runs"), F.col("text")), F.lit("</"), tag, F.lit(">"))
    rows = _ordered(cells, [key, "block_id", "row"], "ord", one, "_row")
    whole = _ordered(rows, [key, "block_id"], "row", F.concat(F.lit("<tr>"), F.col("_row"), F.lit("</tr>")), "_rows")
    return whole.select(key, "block_id", F.concat(F.lit("<table>"), F.col("_rows"), F.lit("</table>")).alias("html"))


def blocks_html(blocks: DataFrame, items: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """key, html of each document; blocks inside quotes stand in their quote in order of their paths."""
    inner = lists_html(items, key).unionByName(tables_html(cells, key)).withColumnRenamed("html", "_inner")
    b = blocks.join(inner, [key, "block_id"], "left")
    body = runs_html(F.col("runs"), F.col("text"))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1)))).cast("string")
    align = F.when(F.col("align").isNotNull(), F.concat(F.lit(' style="text-align:'), F.col("align"), F.lit('"'))).otherwise("")
    html = (
        F.when(F.col("type") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), body, F.lit("</h"), level, F.lit(">")))
        .when(F.col("type").isin("list", "table"), F.coalesce("_inner", F.lit("")))
        .when(F.col("type") == "code", F.concat(F.lit("<pre><code>"), html_escape(F.coalesce("text", F.lit(""))), F.lit("</code></pre>")))
        .when(F.col("type") == "hr", "<hr>")
        .when(F.col("type") == "blank", "<br>")
        .when(F.col("type") == "quote", "")
        .when(F.col("type").isin("image", "image-source"), "")
        .otherwise(F.concat(F.lit("<p"), align, F.lit(">"), body, F.lit("</p>")))
    )
    path = F.transform(F.split("block_id", r"\."), lambda x: F.lpad(x, 9, "0"))
    depth = F.when(F.col("type") == "quote", F.col("depth") + 1).otherwise(F.col("depth"))
    quoted = F.concat(F.repeat(F.lit("<blockquote>"), F.when(F.col("type") == "quote", 1).otherwise(0)), html)
    made = b.select(key, F.array_join(path, ".").alias("_path"), quoted.alias("_html"), depth.alias("_depth"), (F.col("type") == "quote").alias("_quote"))
    # a quote ends before the next block that isn't inside it
    w = Window.partitionBy(key).orderBy("_path")
    shown = F.when(F.col("_quote"), F.col("_depth")).otherwise(F.col("_depth"))
    following = F.coalesce(F.lead(F.when(F.col("_quote"), F.col("_depth") - 1).otherwise(F.col("_depth"))).over(w), F.lit(0))
    closed = F.repeat(F.lit("</blockquote>"), F.greatest(shown - following, F.lit(0)))
    each = made.withColumn("_html", F.concat("_html", closed))
    return _ordered(each, [key], "_path", F.col("_html"), "html")


def standalone(df: DataFrame, key: str) -> DataFrame:
    """key, html of whole pages from key, title, html."""
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="UTF-8"><title>'), html_escape(F.coalesce("title", F.lit(""))), F.lit("</title></head><body>"))
    return df.select(key, F.concat(head, F.coalesce("html", F.lit("")), F.lit("</body></html>")).alias("html"))
