"""Connected components of a graph given as a DataFrame of links, by alternating large and small stars.

Each round replaces links by links to the smallest neighbour until nothing changes; only counts reach the driver.
Minima are combined before each shuffle, so a node with very many links doesn't meet in one task's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link, the roots included.

    links has columns a and b of one type that can be compared; direction and repetition don't matter.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    before = sign(now)
    while before[0]:
        now = cut(_small(_large(now)))
        after = sign(now)
        if after == before:
            break
        before = after
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def extended(tree: DataFrame, links: DataFrame) -> DataFrame:
    """components() of the links that made tree and of further links, from tree and these alone: only roots are linked anew."""
    root = lambda c: tree.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    met = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    top = cut(components(met))
    moved = tree.join(top.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    return moved.unionByName(top.join(tree.select("node"), "node", "left_anti").select("node", "root"))
