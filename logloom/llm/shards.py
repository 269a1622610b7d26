"""Resharding: a minimum-cost flow from old shard sizes to new capacities, then the rows that have to move."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.common import bounded_rows, whole_text
from logloom.session import durable

# Old or new shards of one plan; the flow is solved over shards, never over rows.
MAX_SHARDS = 10_000


@dataclass(frozen=True)
class Transfer:
    """``size`` bytes of shard ``old``, from ``start`` in its order of rows, belong into shard ``new``."""

    old: int
    new: int
    start: int
    size: int


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def cheapest_flow(
    supplies: dict[int, int], capacities: dict[int, int], cost=lambda old, new: int(old != new)
) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard at least total cost, by successive cheapest paths.

    Staying costs nothing and a moved byte costs one, unless ``cost`` says otherwise. Capacities must add
    up to the supplies at least.
    """
    if sum(capacities.values()) < sum(supplies.values()):
        raise ValueError("the new shards are too small")
    flow: dict[tuple[int, int], int] = {}
    # What stays anyway costs nothing, so it is taken at once; the paths settle the rest.
    left, room = dict(supplies), dict(capacities)
    for old in sorted(left):
        if old in room and cost(old, old) == 0 and (size := min(left[old], room[old])):
            flow[old, old] = size
            left[old] -= size
            room[old] -= size
    sources = [s for s in sorted(left) if left[s]]
    while sources:
        # Cheapest paths from all sources with bytes left, over forward edges and back over used ones.
        best: dict[tuple[str, int], int] = {("o", s): 0 for s in sources}
        came: dict[tuple[str, int], tuple[str, int]] = {}
        queue = [(0, ("o", s)) for s in sources]
        heapq.heapify(queue)
        while queue:
            price, node = heapq.heappop(queue)
            if price > best[node]:
                continue
            side, shard = node
            if side == "o":
                steps = [(("n", new), cost(shard, new)) for new in capacities]
            else:
                steps = [(("o", old), -cost(old, shard)) for old in supplies if flow.get((old, shard))]
            for other, extra in steps:
                if price + extra < best.get(other, 1 << 60):
                    best[other], came[other] = price + extra, node
                    heapq.heappush(queue, (price + extra, other))
        free = [("n", new) for new in capacities if room[new] and ("n", new) in best]
        target = min(free, key=lambda node: (best[node], -room[node[1]], node))
        path = [target]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        size = min(left[path[0][1]], room[target[1]])
        for (side, a), (_, b) in zip(path, path[1:]):
            if side == "n":
                size = min(size, flow[b, a])
        for (side, a), (_, b) in zip(path, path[1:]):
            edge, change = ((a, b), size) if side == "o" else ((b, a), -size)
            flow[edge] = flow.get(edge, 0) + change
        left[path[0][1]] -= size
        room[target[1]] -= size
        sources = [s for s in sources if left[s]]
    return {edge: size for edge, size in flow.items() if size}


def transfers(supplies: dict[int, int], capacities: dict[int, int]) -> list[Transfer]:
    """The flow as stretches of each old shard: first what stays, then what goes to each new shard."""
    flow, plan = cheapest_flow(supplies, capacities), []
    for old in sorted(supplies):
        start = 0
        mine = sorted((new for o, new in flow if o == old), key=lambda new: (new != old, new))
        for new in mine:
            plan.append(Transfer(old, new, start, flow[old, new]))
            start += flow[old, new]
    return plan


def place_rows(rows: DataFrame, capacities: list[int] | int, order: list[str]) -> DataFrame:
    """Adds ``shard`` and ``slot`` to narrow rows with ``old_shard`` (int) and ``size`` (bytes, positive).

    ``capacities`` are bytes per new shard, or a number of shards of equal size. The rows of an old shard
    get an order: the largest sizes first, so that what moves and each edge between stretches lies among
    small rows, then blocks, then ``order``, which must tell rows apart or their ties must not matter. An
    old shard has about as many blocks as rows in each, so that neither a block nor the list of blocks in
    a window holds more than about the square root of its rows. A row belongs to the stretch that holds
    its middle; a new shard is off its capacity by the edges of its stretches only. ``slot`` counts from 0
    without gaps.
    """
    spark = rows.sparkSession
    sizes = bounded_rows(rows.groupBy("old_shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")), MAX_SHARDS, "old shards")
    supplies = {row["old_shard"]: row["b"] for row in sizes}
    total = sum(supplies.values())
    wanted = equal_capacities(total, capacities) if isinstance(capacities, int) else capacities
    plan = transfers(supplies, dict(enumerate(wanted)))
    counts = spark.createDataFrame([(r["old_shard"], max(1, round(r["n"] ** 0.5))) for r in sizes], "old_shard int, _blocks int")
    stretches = spark.createDataFrame(
        [(t.old, t.new, t.start, t.start + t.size) for t in plan], "old_shard int, shard int, _from long, _to long"
    )
    # Both small tables have at most MAX_SHARDS squared rows by the bound above, and far fewer in a plan.
    blocked = rows.join(F.broadcast(counts), "old_shard").select(
        *rows.columns,
        (-F.floor(F.log2("size"))).cast("int").alias("_class"),
        F.pmod(F.xxhash64(*order), F.col("_blocks")).cast("int").alias("_block"),
    )
    inside = Window.partitionBy("old_shard", "_class", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("old_shard").orderBy("_class", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("old_shard", "_class", "_block").agg(F.sum("size").alias("_b"), F.count(F.lit(1)).alias("_n"))
    shifts = blocks.select(
        "old_shard", "_class", "_block",
        F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"),
    )
    placed = (
        blocked.withColumn("_b", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("_n", F.count(F.lit(1)).over(inside))
        .join(shifts, ["old_shard", "_class", "_block"])
        .withColumn("_middle", F.col("_bytes") + F.col("_b") + F.floor(F.col("size") / 2))
        .withColumn("_rank", F.col("_rows") + F.col("_n"))
    )
    middle = (F.col("_middle") >= F.col("_from")) & (F.col("_middle") < F.col("_to"))
    moved = placed.join(F.broadcast(stretches.withColumnRenamed("old_shard", "_old")), (F.col("old_shard") == F.col("_old")) & middle)
    moved = durable(moved.select(*rows.columns, "shard", "_rank"))
    found = moved.groupBy("old_shard", "shard").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("old_shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.select("old_shard", "shard", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = moved.join(F.broadcast(bases), ["old_shard", "shard"])
    return joined.select(*rows.columns, "shard", (F.col("_base") + F.col("_rank") - F.col("_first")).alias("slot"))


def document_rows(
    docs: DataFrame, old_shard: Column, id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None
) -> DataFrame:
    """(id, size, text_crc32, old_shard), and columns named in ``also``.

    The size is the text's bytes plus 8; a null text counts as empty.
    """
    raw = whole_text(text_col).cast("binary")
    return docs.select(
        id_col, (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"), *(also or []),
    )


def hash_shard(value: Column, shards: int) -> Column:
    """An old shard from a value's text; a null value counts as empty."""
    return F.pmod(F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def rewrite_affected(spark: SparkSession, folder: str, capacities: list[int] | int, id_col: str = "doc_id") -> list[int]:
    """Reshards a table stored as ``folder``/shard=N and returns the shards whose files were written anew.

    Only shards that lose or gain rows are written; the others keep their files. The new files lie in
    ``folder``-new, where unaffected shards are absent: the caller puts them in place. Whole rows are placed,
    so that null and repeated ids stay as they are.
    """
    docs = spark.read.parquet(folder)
    whole = F.struct(*[F.col(c) for c in docs.columns if c != "shard"]).alias("_row")
    rows = document_rows(docs.select(id_col, "text", "shard", whole), F.col("shard"), id_col, also=["_row"])
    placed = durable(place_rows(rows, capacities, [id_col, "text_crc32", "size"]).select("_row", "old_shard", F.col("shard").alias("_new")))
    moved = placed.filter(F.col("old_shard") != F.col("_new"))
    touched = bounded_rows(moved.select(F.explode(F.array("old_shard", "_new")).alias("s")).distinct(), MAX_SHARDS, "shards")
    touched = sorted(row["s"] for row in touched)
    if touched:
        rows = placed.filter(F.col("_new").isin(touched)).select("_row.*", F.col("_new").alias("shard"))
        rows.write.mode("error").partitionBy("shard").parquet(f"{folder.rstrip('/')}-new")
    return touched
