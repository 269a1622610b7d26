"""Time-ordered state per key: values carry forward until a row clears them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Width of a time block, and of a block of rows without a time.
BLOCK_SECONDS = 3600
BLOCK_ROWS = 100_000


def time_block(time: Column, row: Column, seconds: int = BLOCK_SECONDS, rows: int = BLOCK_ROWS) -> Column:
    """Number of a row's block in (time, row) order; rows without a time come last."""
    timed = F.floor(F.unix_timestamp(time) / seconds)
    return F.when(time.isNotNull(), timed).otherwise(F.lit(10**15) + F.floor(row / rows)).cast("long")


def carry_forward(
    rows: DataFrame,
    key: str,
    block: str,
    order: list[str],
    reset: Column,
    fields: dict[str, tuple[Column, Column | None]],
) -> DataFrame:
    """Effective value per field: own, else carried, else the row's default.

    The first default stays in force until an own value comes; a reset row still uses the
    state and clears it afterwards. Blocks must be ascending in the order. Windows run
    inside (key, block); what a key carries from block to block is a table of one row per
    block, so a key that holds most rows is worked on by many tasks.
    """
    # Keys that cannot be NULL keep the join below from adding filters, so that both of its
    # sides have the same plan up to the shuffle and share it.
    work = rows.withColumns(
        {
            key: F.coalesce(F.col(key), F.lit("")),
            block: F.coalesce(F.col(block), F.lit(0).cast("long")),
            "_reset": F.coalesce(reset, F.lit(False)).cast("int"),
        }
    )
    for name, (own, default) in fields.items():
        work = work.withColumn(f"_own_{name}", own)
        work = work.withColumn(f"_def_{name}", F.lit(None).cast("string") if default is None else default)
    inside = Window.partitionBy(key, block).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    work = work.withColumn("_seg", F.coalesce(F.sum("_reset").over(before), F.lit(0)))
    segment = Window.partitionBy(key, block, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name in fields:
        work = work.withColumn(f"_own_{name}", F.last(f"_own_{name}", ignorenulls=True).over(segment))
        work = work.withColumn(f"_def_{name}", F.first(f"_def_{name}", ignorenulls=True).over(segment))
    state = [f"_{part}_{name}" for name in fields for part in ("own", "def")]

    ends = work.groupBy(key, block).agg(
        F.max("_reset").alias("_cleared"),
        F.max_by(F.struct("_reset", *state), F.struct(*order)).alias("_end"),
    )
    kept = [F.when(F.col("_end._reset") == 0, F.col(f"_end.{s}")).alias(s) for s in state]
    ends = ends.select(key, block, "_cleared", *kept)
    by_key = Window.partitionBy(key).orderBy(block)
    ends = ends.withColumn("_run", F.sum("_cleared").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "_run").orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
    for s in state:
        pick = F.last if s.startswith("_own_") else F.first
        ends = ends.withColumn(s, pick(s, ignorenulls=True).over(run))
    carried = ends.select(key, block, *[F.lag(s).over(by_key).alias(f"_in{s}") for s in state])

    joined = work.join(carried, [key, block])
    fresh = F.col("_seg") == 0
    for name in fields:
        joined = joined.withColumn(
            name,
            F.coalesce(
                F.col(f"_own_{name}"),
                F.when(fresh, F.coalesce(F.col(f"_in_own_{name}"), F.col(f"_in_def_{name}"))),
                F.col(f"_def_{name}"),
            ),
        )
    helpers = ["_reset", "_seg", *state, *[f"_in{s}" for s in state]]
    return joined.drop(*helpers)
