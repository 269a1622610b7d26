"""Stupid-backoff scores from count tables that are partitioned by the hash of the n-gram.

Documents are scored with the counts of the other fold, or (``leave_one_out``) with the counts of all documents
less their own, so that no text vouches for itself. Documents of one block and fold send their distinct n-grams,
packed, to slices of the hash space; a slice sums the counts per fold, joins them to the n-grams that each block
asked for, and answers in the order asked. A block then sums the scores of its documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import ready, whole_text
from logloom.llm.hashing import gram_hashes, lower_words, mixed, word_hashes
from logloom.operators.skew import lookup, lookup_join

ORDER, ALPHA = 2, 0.4
# Bytes of text of one block; n-grams of one slice; n-grams that a task holds before it sends them.
BLOCK_BYTES, SLICE_GRAMS, HELD_GRAMS = 16 << 20, 400_000, 6_000_000
SCHEMA = "block long, slice long, grams binary, counts binary"


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, doc_id, text): a block holds nearby ids of one fold, about ``BLOCK_BYTES`` of text; odd numbers are the
    fold of odd ids.

    Ids are cut into equal ranges between the smallest and the largest, and a range with more text is parted by the
    hash of its ids, so neither sparse nor crowded ids make blocks too small or too large. An id that is no whole
    number goes by its hash, a row without one by the hash of its text.
    """
    number = F.expr(f"try_cast(`{id_col}` AS BIGINT)")
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))), F.lit(1 << 40))
    rows = docs.select(F.coalesce(number, hashed).alias("key"), F.col(f"`{id_col}`").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    # A row's share of a block is at least that of a short text.
    share = F.greatest(F.length("text"), F.lit(64)).cast("long")
    whole = rows.agg(F.min("key").cast("double").alias("lo"), F.max("key").cast("double").alias("hi"), F.sum(share).alias("b")).first()
    ranges = max(1, (whole["b"] or 0) // (2 * BLOCK_BYTES))
    width = max(1.0, ((whole["hi"] or 0.0) - (whole["lo"] or 0.0) + 1) / ranges)
    rows = rows.withColumn("range", (F.floor((F.col("key") - F.lit(whole["lo"] or 0.0)) / F.lit(width)) * 2 + F.pmod("key", F.lit(2))).cast("long"))
    parts = rows.groupBy("range").agg(F.ceil(F.sum(share) / F.lit(BLOCK_BYTES)).cast("long").alias("parts"))
    before = parts.groupBy().agg(F.max("parts").alias("m")).first()["m"] or 1
    crowded = lookup(parts.filter("parts > 1"))
    part = F.pmod(F.xxhash64("key", "text"), F.coalesce("parts", F.lit(1)))
    rows = lookup_join(rows, crowded, ["range"]).withColumn("part", part)
    block = (F.floor(F.col("range") / 2) * F.lit(before) + F.col("part")) * 2 + F.pmod("range", F.lit(2))
    return rows.select(block.cast("long").alias("block"), "doc_id", "text")


def text_grams(raw: bytes, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of each length from one word on."""
    hashes = word_hashes(lower_words(raw))
    return [gram_hashes(hashes, n) for n in range(1, order + 1)]


def sliced(grams: np.ndarray, counts: np.ndarray, slices: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The sorted distinct n-grams of each slice in turn."""
    target = (mixed(grams) % np.uint64(slices)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    target, grams, counts = target[order], grams[order], counts[order]
    edges = np.flatnonzero(np.diff(target, prepend=-1))
    for number, part, count in zip(target[edges].tolist(), np.split(grams, edges[1:]), np.split(counts, edges[1:])):
        yield number, part, count


def asked(rows: DataFrame, order: int, slices: int) -> DataFrame:
    """Distinct n-grams with counts, per block and slice; a task sends a block's whenever it holds many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush():
            for block, parts in held.items():
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                found = list(sliced(grams, counts.astype(np.uint32), slices))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1].tobytes() for f in found], pa.binary()),
                        pa.array([zlib.compress(f[2].tobytes(), 1) for f in found], pa.binary()),
                    ],
                    names=["block", "slice", "grams", "counts"],
                )

        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                for grams in text_grams(raw, order):
                    held.setdefault(block, []).append(grams)
                    size += len(grams)
            if size >= HELD_GRAMS:
                yield from flush()
                held, size = {}, 0
        if size:
            yield from flush()

    return rows.mapInArrow(run, SCHEMA)


def answered(table: pa.Table, both: bool = False) -> pa.Table:
    """For one slice: each block's distinct n-grams in order, answered with the other fold's counts, or those of both."""
    blocks = np.array(table.column("block").to_pylist(), np.int64)
    grams = [np.frombuffer(b, np.uint64) for b in table.column("grams").to_pylist()]
    counts = [np.frombuffer(zlib.decompress(b), np.uint32) for b in table.column("counts").to_pylist()]
    every, place = np.unique(np.concatenate(grams), return_inverse=True)
    fold = np.repeat(blocks & 1, [len(g) for g in grams])
    # Counts stay exact in doubles up to 2**53.
    weight = np.concatenate(counts).astype(np.float64)
    totals = [np.bincount(place[fold == f], weight[fold == f], len(every)) for f in (0, 1)]
    if both:
        totals = [totals[0] + totals[1]] * 2
    out_blocks, out_counts = [], []
    for block in np.unique(blocks):
        mine = [grams[i] for i in np.flatnonzero(blocks == block)]
        wanted = np.unique(np.concatenate(mine)) if len(mine) > 1 else mine[0]
        found = totals[1 - (int(block) & 1)][np.searchsorted(every, wanted)]
        out_blocks.append(int(block))
        out_counts.append(zlib.compress(found.astype(np.uint64).tobytes(), 1))
    return pa.table({
        "block": pa.array(out_blocks, pa.int64()), "slice": pa.array([table.column("slice")[0].as_py()] * len(out_blocks), pa.int64()),
        "counts": pa.array(out_counts, pa.binary()),
    })


def fold_words(rows: DataFrame) -> dict[int, int]:
    """Words of the even and of the odd fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0, 0]
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                totals[block & 1] += len(raw.split())
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(totals, pa.int64())], names=["fold", "words"])

    found = rows.mapInArrow(run, "fold int, words long").groupBy("fold").agg(F.sum("words").alias("words")).collect()
    return {0: 0, 1: 0} | {row["fold"]: row["words"] for row in found}


def others(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of a document's n-grams without the times that the document itself has them."""
    _, place, own = np.unique(grams, return_inverse=True, return_counts=True)
    return counts - own[place]


def log_scores(levels: list[np.ndarray], counts: list[np.ndarray], total: int, alpha: float) -> np.ndarray:
    """Natural log score per word: the longest n-gram that has counts, and a factor for each step back.

    A word without counts counts as half a word; without any counts at all, as half a word of one.
    """
    n = len(levels[0])
    seen = counts[0] > 0
    score = np.log(np.where(seen, counts[0], 0.5) / max(total, 1))
    for size in range(2, len(levels) + 1):
        has = counts[size - 1] > 0
        context = counts[size - 2][: n - size + 1]
        ratio = np.log(np.where(has, counts[size - 1], 1) / np.where(has, np.maximum(context, 1), 1))
        tail = score[size - 1 :]
        # Only a word with a full context of this size steps back from it.
        score[size - 1 :] = np.where(has, ratio, tail + np.log(alpha))
    return score


def score_documents(
    docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text",
    leave_one_out: bool = False,
) -> DataFrame:
    """Per row: ``n_words``, ``n_backoff`` (words scored below the full order), ``log_score`` (natural log, summed)
    and ``mean_log_score`` (null without words). Null and empty texts score 0 over no words.

    With ``leave_one_out`` a row is scored with the counts of all other rows, whatever the ids are.
    """
    spark = ready(docs.sparkSession)
    rows = blocks_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    totals = fold_words(rows)
    slices = sum(totals.values()) * order // SLICE_GRAMS + 1
    answers = asked(rows, order, slices).groupBy("slice").applyInArrow(
        lambda table: answered(table, leave_one_out), "block long, slice long, counts binary"
    )

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_backoff", "log_score"]
        if not texts.num_rows:
            return pa.table([pa.nulls(0, texts.schema.field("doc_id").type), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64()))], names=names)
        fold = texts.column("block")[0].as_py() & 1
        levels = [text_grams(raw, order) for raw in texts.column("text").to_pylist()]
        every = np.unique(np.concatenate([g for grams in levels for g in grams]))
        replies = dict(zip(found.column("slice").to_pylist(), found.column("counts").to_pylist()))
        counts = np.zeros(len(every), np.float64)
        for number, grams, places in sliced(every, np.arange(len(every)), slices):
            counts[places] = np.frombuffer(zlib.decompress(replies[number]), np.uint64)
        out = []
        for grams in levels:
            known = []
            for g in grams:
                found_counts = counts[np.searchsorted(every, g)]
                known.append(others(g, found_counts) if leave_one_out else found_counts)
            total = sum(totals.values()) - len(grams[0]) if leave_one_out else totals[1 - fold]
            scores = log_scores(grams, known, total, alpha)
            full = int((known[-1] > 0).sum())
            out.append((len(grams[0]), len(grams[0]) - full, float(scores.sum())))
        columns = [texts.column("doc_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64())))]
        return pa.table(columns, names=names)

    paired = rows.groupBy("block").cogroup(answers.groupBy("block"))
    scored = paired.applyInArrow(score, f"doc_id {kind}, n_words long, n_backoff long, log_score double")
    return scored.select(
        F.col("doc_id").alias(id_col), "n_words", "n_backoff", "log_score",
        (F.col("log_score") / F.nullif("n_words", F.lit(0))).alias("mean_log_score"),
    )
