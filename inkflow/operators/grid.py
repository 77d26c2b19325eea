"""Tables as grids: padding, placement of spans, coverage, merged runs, column widths."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import display_width
from ..functions.units import LEAST_COLUMN, round_half_up


def padded(row: Column, n: Column) -> Column:
    """An array of n texts: the row's, then empty ones."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(row, i), F.lit("")))


PLACED = "row int, col int, col_span int, row_span int, text string, filler boolean"


def place(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Grid places of cells (row, ord, col_span, row_span, text): each in the first free column of its row, spans cut where the grid ends or
    another cell stands, and fillers of one cell where nothing does. The grid is as wide as the spans of its first row, or of its widest row."""
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "ord"])
        n_rows = int(group["row"].max()) + 1
        width = int(group.groupby("row")["col_span"].sum().max())
        taken = [[False] * width for _ in range(n_rows)]
        out = []
        for row, span, down, text in zip(group["row"], group["col_span"], group["row_span"], group["text"]):
            free = next((c for c in range(width) if not taken[row][c]), None)
            if free is None:
                continue
            span, down = 1 if span < 1 else int(span), 1 if down < 1 else int(down)
            across = 1
            while across < span and free + across < width and not taken[row][free + across]:
                across += 1
            deep = 1
            while deep < down and row + deep < n_rows and not any(taken[row + deep][free : free + across]):
                deep += 1
            for r in range(row, row + deep):
                taken[r][free : free + across] = [True] * across
            out.append((row, free, across, deep, text, False))
        out += [(r, c, 1, 1, "", True) for r in range(n_rows) for c in range(width) if not taken[r][c]]
        made = pd.DataFrame(sorted(out, key=lambda x: x[:2]), columns=["row", "col", "col_span", "row_span", "text", "filler"])
        for i, k in enumerate(keys):
            made.insert(i, k, group[k].iloc[0])
        return made

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [PLACED])
    return cells.select(*keys, "row", "ord", "col_span", "row_span", "text").groupBy(*keys).applyInPandas(run, schema)


def coverage(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Grid places that aren't covered exactly once: keys, row, col, n. cells has row, col, col_span, row_span."""
    spots = cells.select(*keys, F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("r"), "col", "col_span").select(*keys, "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("c"))
    counted = spots.groupBy(*keys, "r", "c").agg(F.count(F.lit(1)).alias("n"))
    size = cells.groupBy(*keys).agg(F.max(F.col("row") + F.col("row_span")).alias("n_rows"), F.max(F.col("col") + F.col("col_span")).alias("n_cols"))
    whole = size.select(*keys, "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("r")).select(*keys, "r", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("c"))
    wrong = whole.join(counted, [*keys, "r", "c"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return wrong.where("n <> 1").select(*keys, F.col("r").alias("row"), F.col("c").alias("col"), "n")


def merged_down(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Vertical merges (merge: 'restart', 'continue' or null; row, col) as row spans: the cells that stay, with row_span.

    A run is a cell that restarts and the cells of its column that continue in the rows right below.
    """
    w = Window.partitionBy(*keys, "col").orderBy("row")
    starts = F.when(F.coalesce(F.col("merge") != "continue", F.lit(True)) | (F.lag("row").over(w) != F.col("row") - 1) | F.lag("row").over(w).isNull() | F.lag("merge").over(w).isNull(), 1).otherwise(0)
    runs = cells.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "col", "_run"))
    return runs.withColumn("row_span", size).where("_new = 1").drop("_new", "_run", "merge")


def column_widths(cells: DataFrame, keys: list[str], table_width: int) -> DataFrame:
    """keys, col, width: LEAST_COLUMN each and the rest by the widest text of each column; what rounding leaves goes to the last; equal shares where that
    doesn't fit. cells has col and text, one cell for each column of each row."""
    widest = cells.groupBy(*keys, "col").agg(F.greatest(F.lit(1), F.max(display_width(F.coalesce("text", F.lit(""))))).alias("longest"))
    w = Window.partitionBy(*keys)
    shares = widest.withColumns({"n": F.count(F.lit(1)).over(w), "total": F.sum("longest").over(w)})
    usable = F.lit(table_width) - F.col("n") * LEAST_COLUMN
    raw = F.when(F.col("n") == 1, table_width).when(usable <= 0, F.floor(F.lit(table_width) / F.col("n"))).otherwise(round_half_up(LEAST_COLUMN + F.col("longest") / F.col("total") * usable)).cast("long")
    sized = shares.withColumn("width", raw)
    left = F.lit(table_width) - F.sum("width").over(w)
    last = F.col("col") == F.max("col").over(w)
    return sized.withColumn("width", F.when(last & (usable > 0), F.col("width") + left).otherwise(F.col("width"))).select(*keys, "col", "width")
