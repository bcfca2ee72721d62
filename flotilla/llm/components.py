"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Link a node's smaller neighbours, and the node, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0))).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has an edge; root is the smallest
    node of its component and has a row of its own.

    ``edges`` has long columns a and b in any direction; loops, repeated
    edges and nulls are ignored. Each round ends in a written table, and only
    the count and the sum of edge hashes come to the driver.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(spark, now, "edges")
    seen = _digest(now)
    while seen[0]:
        now = written(spark, _small(_large(now)), "edges")
        after = _digest(now)
        if after == seen:
            break
        seen = after
    tree = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tree.union(tree.select(F.col("root").alias("node"), "root").distinct())
