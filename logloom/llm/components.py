"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import durable, release


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the root is the smallest node of the component.

    Every step is an aggregation with map-side combining and a join, so a node with many neighbours is no
    group in one task; each round is cut off by a checkpoint, and what
    earlier rounds wrote is removed. It ends when a round changes nothing.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = durable(edges.filter(F.col("a") != F.col("b")).select(high, low).distinct())
    state = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.filter(F.col("m") < F.col("a")).select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        current = durable(small.select(high, low).union(least.select("a", F.col("m").alias("b"))).distinct())
        row = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
        del both, least, large, small
        release(edges.sparkSession)
    roots = current.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
