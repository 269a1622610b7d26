"""Positions of rows inside their group, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import scratch_path

# Largest table of offsets that is sent to every executor, in rows of about 50 bytes.
BROADCAST_ROWS = 200_000


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows with ``pos`` (from 0, inside the key, by ``order``) and ``n`` (rows of the key).

    The rows are dealt by ranges of (key, order) and sorted there, so a key with a third of the rows lies in many
    tasks; each range then moves by the counts of the key's earlier ranges. The key must not be null; nulls of the
    order columns come first; rows equal in all of them stand in any order. The ranges are written to the shared
    folder, hence a lost executor cannot change them between the two passes.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "ranges")
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    dealt.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    dealt = spark.read.parquet(path).withColumn("_range", F.shiftright("_row", 33))
    ranges = dealt.groupBy(key, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_count"))
    whole = Window.partitionBy(key)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        key, "_range", (F.coalesce(F.sum("_count").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_count").over(whole).alias("n"),
    )
    path = scratch_path(spark, "offsets")
    offsets.write.parquet(path)
    offsets = spark.read.parquet(path)
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = dealt.join(offsets, [key, "_range"])
    return placed.withColumn("pos", F.col("_row") + F.col("_shift")).drop("_row", "_range", "_shift")
