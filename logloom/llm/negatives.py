"""Hard negatives by exact inner products, with length buckets and ranges of coordinates that can still be good enough.

Rows are ordered by length and cut into stripes of bounded bytes; a stripe holds buckets of similar length, and every
bucket a sorted list of its directions per coordinate. Anchors are cut into blocks, and each pair of a stripe and a
block is one small task. There an anchor with a threshold t for its cosine can only use rows whose coordinate lies
within acos(t) of its own, as an angle: for its largest coordinates these ranges are looked up in the sorted lists,
their rows intersected, and what is left is verified with whole integer products.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.numbering import numbered
from logloom.session import scratch_path

# Bytes of one stripe's vectors as 64-bit numbers, and the most rows that it has.
STRIPE_BYTES, STRIPE_ROWS = 4 << 20, 8192
BUCKET_ROWS = 1024
BLOCK_ROWS = 1024
# Coordinates of an anchor whose ranges are intersected.
FOCUS = 4
# Whole numbers up to here are exact as doubles.
EXACT = 2.0**53
SLACK = 1e-9
LONG = np.iinfo(np.int64)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of whole numbers as a matrix; shorter ones end in zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], column.type)
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def widen(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whole inner products, rows by anchors; what no 64-bit number holds stops at its ends."""
    width = max(rows.shape[1], 1)
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if most(rows) * most(anchors) * width < EXACT:
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    exact = rows.astype(object) @ anchors.astype(object).T
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64).reshape(len(rows), len(anchors))


class Bucket:
    """Rows of similar length with their directions sorted along every coordinate."""

    def __init__(self, ids: np.ndarray, labels: list, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.longest = float(lengths.max(initial=0))
        self.directions = np.ascontiguousarray((vectors / np.where(lengths > 0, lengths, 1)[:, None]).T)
        self.order = np.argsort(self.directions, axis=1)
        self.sorted = np.take_along_axis(self.directions, self.order, axis=1)

    def candidates(self, direction: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose focus coordinates allow a cosine of at least ``cosine``; None stands for all rows."""
        spread = np.arccos(min(cosine, 1.0)) + SLACK
        angles = np.arccos(np.clip(direction[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, angles + spread)) - SLACK
        high = np.cos(np.maximum(0.0, angles - spread)) + SLACK
        first = [np.searchsorted(self.sorted[f], x, "left") for f, x in zip(focus, low)]
        last = [np.searchsorted(self.sorted[f], x, "right") for f, x in zip(focus, high)]
        sizes = np.subtract(last, first)
        best = int(np.argmin(sizes))
        if sizes[best] == len(self.ids):
            return None
        rows = self.order[focus[best], first[best] : last[best]]
        for i, f in enumerate(focus):
            if i != best and sizes[i] < len(self.ids):
                values = self.directions[f, rows]
                rows = rows[(values >= low[i]) & (values <= high[i])]
        return rows


class Best:
    """The k best rows so far, by score and then by smaller id, among scores from ``low`` to ``high``."""

    def __init__(self, k: int, low: int = LONG.min, high: int = LONG.max):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.low) & (scores <= self.high))
        if not len(fits):
            return
        scores, ids = np.concatenate([self.scores, scores[fits]]), np.concatenate([self.ids, ids[fits]])
        # ~x turns the order round without an overflow at the smallest number.
        first = np.lexsort((ids, ~scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]
        if len(first) == self.k:
            # An equal score may still win by a smaller id.
            self.low = max(self.low, int(self.scores[-1]))


def search(stripe: dict, block: dict, goals: list[list[Best]], same: bool) -> None:
    """Offer every row of the stripe that can reach an anchor's goals to them; ``same`` asks for its label or others."""
    width = max(stripe["vectors"].shape[1], block["vectors"].shape[1])
    vectors, anchors = widen(stripe["vectors"], width), widen(block["vectors"], width)
    lengths, reach = lengths_of(vectors), lengths_of(anchors)
    directions = anchors / np.where(reach > 0, reach, 1)[:, None]
    focus = np.argsort(-np.abs(directions), axis=1, kind="stable")[:, :FOCUS]
    for start in range(0, len(vectors), BUCKET_ROWS):
        part = slice(start, start + BUCKET_ROWS)
        bucket = Bucket(stripe["ids"][part], stripe["labels"][part], vectors[part], lengths[part])
        all_rows, chosen = [], []
        for a, wanted in enumerate(goals):
            if not wanted:
                continue
            low = min(goal.low for goal in wanted)
            if low <= 0:
                all_rows.append(a)
                continue
            most = reach[a] * bucket.longest
            if low > most * (1 + SLACK):
                continue
            rows = bucket.candidates(directions[a], focus[a], low / most * (1 - SLACK)) if width else None
            if rows is None or 2 * len(rows) > len(bucket.ids):
                all_rows.append(a)
            elif len(rows):
                chosen.append((a, rows))
        for at in range(0, len(all_rows), 256):
            some = all_rows[at : at + 256]
            scores = products(bucket.vectors, anchors[some])
            for i, a in enumerate(some):
                _offer(bucket, slice(None), scores[:, i], block, a, goals[a], same)
        for a, rows in chosen:
            _offer(bucket, rows, products(bucket.vectors[rows], anchors[a : a + 1])[:, 0], block, a, goals[a], same)


def _offer(bucket: Bucket, rows, scores: np.ndarray, block: dict, a: int, goals: list[Best], same: bool) -> None:
    ids = bucket.ids[rows]
    fits = ((bucket.labels[rows] == block["labels"][a]) == same) & (ids != block["ids"][a])
    scores, ids = scores[fits], ids[fits]
    for goal in goals:
        goal.add(scores, ids)


def _pack(key: str):
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        body = {
            "ids": rows["id"].to_numpy(), "labels": rows["label"].to_numpy(), "vectors": matrix(rows["vector"]),
            "pos": rows["pos"].to_numpy(), "positives": rows["positives"].to_pylist() if "positives" in rows.column_names else None,
        }
        return pa.table({key: [rows[key][0].as_py()], "body": pa.array([pickle.dumps(body, 5)], pa.binary())})

    return pack


def _packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """One row per ``size`` rows of ``pos``, in the shared folder."""
    path = scratch_path(rows.sparkSession, f"packed-{key}")
    cut = rows.withColumn(key, F.floor(F.col("pos") / F.lit(size)).cast("long"))
    cut.groupBy(key).applyInArrow(_pack(key), f"{key} long, body binary").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _meet(stripes: DataFrame, blocks: DataFrame, n_stripes: int, n_blocks: int, work, schema: str) -> DataFrame:
    """``work`` on every pair of a stripe and a block, each a group of two packed rows."""
    left = stripes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    right = blocks.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_stripes - 1).cast("long"))))
    keys = ["stripe", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    Components become floor(scale * x), scores are whole inner products. An anchor's positives are the first rows of
    its label; a negative has another label and between ``low`` and ``high`` per cent of the positive's score. Ties
    go to the smaller id. ``anchors`` is a condition on the columns of ``rows``, which may be any share of them:
    stripes and blocks are paired, so the work is anchors times rows less what the ranges exclude, in tasks of
    bounded size, and no label or group of equal vectors is gathered.

    Ids and labels are whole numbers. Rows with a null id, label or vector, or a null or non-finite component take no part. Rows that share an
    anchor's id are not its partners; other repeated rows count one by one. Vectors of unequal size are compared as
    if the shorter one ended in zeros. Scores beyond 64 bits stop at the ends of that range. Other columns are not
    read. An empty table, or one without anchors, gives no rows.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = rows.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & vector.isNotNull() & sound)
    kept = kept.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x)).alias("vector"),
        anchors.alias("anchor"), F.lit("").alias("all"),
    )
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    placed = numbered(kept.withColumn("shortness", -squares), "all", ["shortness", "id"])
    size = placed.agg(F.max("n").alias("n"), F.max(F.size("vector")).alias("width")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    chosen = numbered(placed.filter("anchor").select("id", "label", "vector", "all"), "all", ["id"])
    n_anchors = chosen.agg(F.max("n").alias("n")).first()["n"]
    if not n_anchors:
        return spark.createDataFrame([], schema)
    stripe_rows = max(1, min(STRIPE_ROWS, STRIPE_BYTES // (8 * max(size["width"], 1))))
    stripes = _packed(placed.select("id", "label", "vector", "pos"), "stripe", stripe_rows)
    counts = -(-size["n"] // stripe_rows), -(-n_anchors // BLOCK_ROWS)
    chosen = chosen.select("id", "label", "vector", "pos")

    def best_positives(stripe: pa.Table, block: pa.Table) -> pa.Table:
        stripe, block = (pickle.loads(t["body"][0].as_py()) for t in (stripe, block))
        goals = [[Best(positives)] for _ in block["ids"]]
        search(stripe, block, goals, True)
        found = [goal for (goal,) in goals]
        return pa.table(
            {
                "pos": np.repeat(block["pos"], [len(g.ids) for g in found]),
                "positive_id": np.concatenate([g.ids for g in found]), "positive_score": np.concatenate([g.scores for g in found]),
            }
        )

    near = _meet(stripes, _packed(chosen, "block", BLOCK_ROWS), *counts, best_positives, "pos long, positive_id long, positive_score long")
    order = Window.partitionBy("pos").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    # An anchor has at most ``positives`` of them.
    lists = near.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    blocks = _packed(chosen.join(lists, "pos"), "block", BLOCK_ROWS)

    def best_negatives(stripe: pa.Table, block: pa.Table) -> pa.Table:
        names = ("pos", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        out = {name: [] for name in names}
        if len(stripe) and len(block):
            stripe, block = (pickle.loads(t["body"][0].as_py()) for t in (stripe, block))
            goals = []
            for rows in block["positives"]:
                bounds = [(-(-low * r["positive_score"] // 100), high * r["positive_score"] // 100) for r in rows]
                goals.append([Best(negatives, *b) if b[0] <= b[1] else None for b in bounds])
            search(stripe, block, [[g for g in some if g is not None] for some in goals], False)
            for a, some in enumerate(goals):
                for goal, r in zip(some, block["positives"][a]):
                    if goal is not None:
                        for i, s in zip(goal.ids.tolist(), goal.scores.tolist()):
                            values = (int(block["pos"][a]), r["place"], int(block["ids"][a]), r["positive_id"], r["positive_score"], i, s)
                            for name, value in zip(names, values):
                                out[name].append(value)
        return pa.table({name: pa.array(out[name], pa.int32() if name == "place" else pa.int64()) for name in names})

    fields = "pos long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = _meet(stripes, blocks, *counts, best_negatives, fields)
    order = Window.partitionBy("pos", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
