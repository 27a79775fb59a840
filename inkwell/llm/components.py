"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import apart, cut, drop


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> node, component: the least node that can be reached. Every node has an edge; loops and repeats do no harm.

    Each step is two aggregations and joins over the edges, checkpointed; it ends when the edges stay the same,
    after about the logarithm of the longest path. The aggregates are dealt anew before they are joined, so that
    adaptive execution can split the edges of a hub. Nothing but a count and a checksum reaches the driver.
    """

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        drop(e)
        e = cut(large.join(apart(small), "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        drop(large)
        after = mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
