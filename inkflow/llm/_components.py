"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, join_groups, save


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Each neighbour larger than a node is linked with the smallest of the node and its neighbours."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_groups(both, least, ["a"], "n", 2 * total).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_groups(down, least, ["a"], "n", total).where("b <> m").select(F.col("m").alias("a"), "b")
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node in links (a, b), roots included.

    Each step is written to the shared folder, so lineage stays short. Only counts come to the driver. A hub's links stay where they are.
    """
    spark = links.sparkSession
    now = save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        # done when each larger node has one link and no smaller node has a link to a smaller one yet: stars
        star, total = now.groupBy("b").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        if star is None or (star == 1 and now.select("a").distinct().join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()):
            break
        step = save(_small_star(_large_star(now, total), total), "links")
        drop(spark, now)
        now = step
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
