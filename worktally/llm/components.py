"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktally.llm.common import stored


def _stars(links: DataFrame) -> DataFrame:
    """Large-star and small-star: every node's larger neighbours, then the node itself and its smaller ones, meet its least neighbour."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("low"))
    small = large.join(least, "a")
    return (
        small.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b")
        .unionByName(least.select("a", F.col("low").alias("b"))).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), the root being the least node that can be reached.

    Work happens on links alone; each round is written out, and rounds end when nothing changes.
    Self-links are dropped, so a node with no other link has no row.
    """
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    mark = None
    while True:
        # Roots only fall; the figures stand still once every node points at its root.
        now = tuple(links.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark, links = now, stored(_stars(links), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
