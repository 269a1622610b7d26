"""Building blocks that keep a hot key from landing in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import durable

# Largest table that is sent to every executor, in bytes of its JSON text.
BROADCAST_BYTES = 32 * 1024 * 1024
# Copies a lookup table is given when it is too large to broadcast; one, as Spark splits hot partitions of the facts.
SALTS = 1


def text_size(columns: list[str]) -> Column:
    """Bytes of a row's JSON text."""
    return F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))


def text_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(text_size(df.columns)).alias("b")).first()["b"] or 0


@dataclass(frozen=True)
class Lookup:
    """A materialised table with unique keys, and whether its size allows a broadcast."""

    table: DataFrame
    small: bool


def lookup(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> Lookup:
    table = durable(table)
    return Lookup(table, text_bytes(table) <= max_bytes)


def lookup_join(
    facts: DataFrame,
    table: DataFrame | Lookup,
    keys: list[str],
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join facts to a lookup table whose keys are unique and may be hot in the facts.

    The table is materialised and measured. Within ``max_bytes`` it is broadcast and the
    facts are not shuffled; beyond it both sides are sorted and merged by key, and the adaptive skew
    join splits the facts of a hot key among tasks (``session.prepare``). The hint says so because Spark
    takes the table's size from its input files, which may be far smaller, and would broadcast it. With
    ``salts`` above one each entry gets that many copies instead: a large table grows as many times,
    whether keys are hot or not.
    """
    side = table if isinstance(table, Lookup) else lookup(table, max_bytes)
    if side.small:
        return facts.join(F.broadcast(side.table), keys, how)
    if salts <= 1:
        return facts.join(side.table.hint("merge"), keys, how)
    salted = side.table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = facts.withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(salts)).cast("int")
    )
    return spread.join(salted.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def number_within(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """1-based position of each row among the rows of its key, by a unique order.

    Rows are dealt by ranges of (keys, order) with about as many rows each, whatever the values are, so a key with
    most rows lies in many ranges and is sorted by many tasks. Rows are numbered inside (key, range); only the first
    and the last key of a range can go on in another one, and theirs are moved by the counts of earlier ranges. Keys
    must not be NULL.
    """
    dealt = df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    dealt = durable(dealt.withColumn("_range", F.shiftright(F.monotonically_increasing_id(), 33).cast("int")))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    numbered = dealt.withColumn("_rn", F.row_number().over(inside))
    named = F.struct(*keys)
    edges = dealt.groupBy("_range").agg(F.array(F.min(named), F.max(named)).alias("_ends"))
    # Two keys per range at most, so this is small at any size.
    wide = edges.select(F.explode("_ends").alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    wide = wide.filter("_n > 1").select("_k.*")
    counts = dealt.join(F.broadcast(wide), keys, "left_semi").groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "_range", F.sum("_n").over(earlier).alias("_shift")).filter("_shift IS NOT NULL")
    placed = numbered.join(F.broadcast(shifts), [*keys, "_range"], "left")
    return placed.withColumn(out, F.coalesce("_shift", F.lit(0)) + F.col("_rn")).drop("_range", "_rn", "_shift")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; the rank filter is applied before the shuffle as well."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k)
