"""Connected components of an edge list by alternating star steps, with every step written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hirelake.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, root): the least node reachable from each node that has an edge to another.

    A node's neighbours are reduced to their least one before they meet it, so a hub never gathers
    in one task; each step's table is written and read again. Self loops and repeated edges are fine.
    """

    def falling(df: DataFrame) -> DataFrame:
        return df.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    now = written(falling(edges), "edges")
    before, after = None, state(now)
    while after != before and after[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(falling(large), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(falling(small.unionByName(least.select("a", F.col("m").alias("b")))), "edges")
        before, after = after, state(now)
    rooted = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return rooted.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
