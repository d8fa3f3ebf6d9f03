"""Connected components of a table of links, by stars: every node learns the smallest node of its neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(links: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to its smallest neighbour."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small(links: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, move to the smallest of them. Links point from a to the larger b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b")
    ends = moved.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return ends.where("a < b")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node it is linked to over any number of links) of every node that has a link.

    ``links`` has columns a < b. Rounds of large and small stars, written after each; they end when every link ends in its
    root, that is when a round changes nothing. A round needs sums and joins by node, no list of a node's neighbours.
    """
    now = written(links.distinct(), "links")
    while True:
        after = written(_small(_large(now)).distinct(), "links")
        if _digest(after) == _digest(now):
            return after.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(after.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        now = after


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
