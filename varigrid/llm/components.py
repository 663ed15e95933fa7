"""Connected components of links by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import dropped, written


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one root and no root points on."""
    roles = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    counts = roles.groupBy("a").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return counts.where("out > 1 or (out > 0 and in > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``a, root`` for each end of ``links`` (``a``, ``b``; longs): the smallest id that links reach.

    Self-links, repeated links and null ends are ignored. Each round is written to the shared folder, and
    rounds grow with the logarithm of the longest path. No neighbour list is ever gathered in one place.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        low = written(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")), "large-star")
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = written(small.where("a <> b").distinct(), "small-star")
        dropped(edges, low)
        edges = after
    roots = edges.select("a", F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct())
