"""Repeated passages by sparse suffixes: only suffixes that start at minimisers are sorted and compared.

A passage of ``length`` words holds a minimiser, chosen by content alone, so equal passages hold the same
one. Sparse suffixes are sorted by their first half passage; neighbours that agree show where a passage
may repeat. From there the match is extended left and right: the segment of all full-length stretches around such
a suffix is compared first, then, where segments of a seed differ, stretch by stretch; what is found in another
document is joined to the longest spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import ready, whole_text
from logloom.llm.hashing import PRIME, as_long, digest, gram_hashes, lower_words, mixed, word_hashes
from logloom.session import durable, scratch_path

LENGTH = 50
SLICE_ROWS = 500_000
# The half of a seed that gives way to its place: texts have fewer than 2**32 words.
LOW = np.uint64(0xFFFFFFFF)
# Bits of the filter of repeated suffixes; its size is bounded, and a full filter costs time but no result.
MIN_BITS, MAX_BITS = 16, 27


def sparse_starts(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, seed) of each sparse suffix, and for every stretch of ``length`` words the number of its suffix."""
    seeds = gram_hashes(hashes, length // 2)
    span = length - length // 2 + 1
    if len(seeds) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    # The least of each window, its place in the low half: windows of doubled width, then two that overlap.
    least, width = (seeds & ~LOW) | np.arange(len(seeds), dtype=np.uint64), 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    least = (least & LOW).astype(np.int64)
    # Places never go back from one window to the next.
    first = np.diff(least, prepend=-1) > 0
    starts, owner = least[first], np.cumsum(first) - 1
    return starts, seeds[starts], owner


def documents_of(rows: DataFrame) -> DataFrame:
    """(doc_id, n_words, node): the node digests the words, so equal word sequences are one node."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [word_hashes(lower_words(raw)) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, hashes), pa.int64()), pa.array(map(digest, hashes), pa.int64())],
                names=["doc_id", "n_words", "node"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, node long")


def repeated_seeds(rows: DataFrame, length: int, slices: int) -> DataFrame:
    """The seeds of sparse suffixes that start in at least two different documents.

    A task sends a seed at most twice per flush, with two of its documents, so a common passage costs a
    slice no more than there are flushes.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            pairs = np.concatenate(held)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            first = np.ones(len(pairs), bool)
            first[1:] = pairs[1:, 0] != pairs[:-1, 0]
            last = np.roll(first, -1)
            pairs = pairs[first | last]
            target = (mixed(pairs[:, 0]) % np.uint64(slices)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            pairs, target = pairs[order], target[order]
            edges = np.flatnonzero(np.diff(target, prepend=-1))
            blobs = [part.tobytes() for part in np.split(pairs, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(target[edges], pa.int64()), pa.array(blobs, pa.binary())], names=["slice", "packed"])

        for batch in batches:
            for raw in batch.column(1).to_pylist():
                hashes = word_hashes(lower_words(raw))
                _, seeds, _ = sparse_starts(hashes, length)
                if len(seeds):
                    node = np.full(len(seeds), np.int64(digest(hashes))).view(np.uint64)
                    held.append(np.stack([seeds, node], axis=1))
                    size += len(seeds)
            if size >= 500_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def neighbours(table: pa.Table) -> pa.Table:
        pairs = np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, 2) for b in table.column("packed").to_pylist()])
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        equal = (pairs[1:, 0] == pairs[:-1, 0]) & (pairs[1:, 1] != pairs[:-1, 1])
        return pa.table({"seed": pa.array(as_long(np.unique(pairs[1:, 0][equal])))})

    return rows.mapInArrow(deal, "slice long, packed binary").groupBy("slice").applyInArrow(neighbours, "seed long")


def key_filter(keys: DataFrame, count: int) -> np.ndarray:
    """A bit per leading part of the one column ``key``; a power of two of bits, at least 16 for each key up to the bound."""
    bits = min(max((count * 16).bit_length(), MIN_BITS), MAX_BITS)
    place = f"shiftrightunsigned(key, {64 - bits})"
    words = keys.select(F.expr(f"cast(shiftright({place}, 6) as int)").alias("w"), F.expr(f"shiftleft(1L, cast({place} & 63 as int))").alias("bit"))
    found = words.groupBy("w").agg(F.bit_or("bit").alias("bits"))
    filled = np.zeros(1 << (bits - 6), np.int64)
    # At most 2**21 rows of twelve bytes by the bound on the filter.
    for row in found.toLocalIterator():
        filled[row["w"]] = row["bits"]
    return filled


def passes(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = len(filled).bit_length() + 5
    at = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return ((filled[at >> 6] >> (at & 63)) & 1).astype(bool)


def shared_segments(hashes: np.ndarray, length: int, filled: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(seed, segment, start, size) of the sparse suffixes that the filter lets through, and the stretches' hashes.

    A suffix stands for ``size`` stretches from ``start`` on; the segment digests all words that they cover. None if
    the filter lets nothing through.
    """
    _, seeds, owner = sparse_starts(hashes, length)
    may = passes(filled, seeds)
    if not may.any():
        return None
    stretches = gram_hashes(hashes, length)
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    size = np.diff(start, append=len(owner))[may]
    start = start[may]
    segment = mixed(stretches[start] * PRIME + stretches[start + size - 1] + size.astype(np.uint64))
    return seeds[may], segment, start, size, stretches


def texts_once(make, columns: dict[str, pa.DataType]):
    """A function on batches that calls ``make(hashes, node)`` for the texts of a task and yields the arrays it gives.

    Copies in one task are looked at once; the set stays small, and forgetting repeats work only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            found = []
            for raw in batch.column(1).to_pylist():
                hashes = word_hashes(lower_words(raw))
                node = digest(hashes)
                if node in done:
                    continue
                done.add(node)
                if len(done) > 100_000:
                    done.clear()
                arrays = make(hashes, node)
                if arrays is not None:
                    found.append(arrays)
            if found:
                whole = [np.concatenate(x) for x in zip(*found)]
                for at in range(0, len(whole[0]), 10_000):
                    parts = [pa.array(c[at : at + 10_000], kind) for c, kind in zip(whole, columns.values())]
                    yield pa.RecordBatch.from_arrays(parts, names=list(columns))

    return run


def segments_of(rows: DataFrame, length: int, shared) -> DataFrame:
    """(seed, segment, node, start, size) of the suffixes whose seed may start in several documents."""

    def make(hashes: np.ndarray, node: int):
        found = shared_segments(hashes, length, shared.value)
        if found is None:
            return None
        seeds, segments, start, size, _ = found
        return as_long(seeds), as_long(segments), np.full(len(start), node, np.int64), start, size

    columns = {"seed": pa.int64(), "segment": pa.int64(), "node": pa.int64(), "start": pa.int32(), "size": pa.int32()}
    return rows.mapInArrow(texts_once(make, columns), "seed long, segment long, node long, start int, size int")


def stretches_of(rows: DataFrame, length: int, shared, wanted) -> DataFrame:
    """(stretch, node, start) of the stretches of the wanted segments; the nodes that have one are keys as well."""

    def make(hashes: np.ndarray, node: int):
        found = shared_segments(hashes, length, shared.value) if passes(wanted.value, np.array([node])).any() else None
        if found is None:
            return None
        _, segments, start, size, stretches = found
        take = passes(wanted.value, as_long(segments) ^ np.int64(node))
        start, size = start[take], size[take]
        if not len(start):
            return None
        places = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        return as_long(stretches[places]), np.full(len(places), node, np.int64), places

    columns = {"stretch": pa.int64(), "node": pa.int64(), "start": pa.int32()}
    return rows.mapInArrow(texts_once(make, columns), "stretch long, node long, start int")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from Parquet in the shared folder."""
    path = scratch_path(df.sparkSession, "suffixes")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def joined_spans(starts: list[int], length: int) -> list[tuple[int, int]]:
    spans: list[list[int]] = []
    for start in sorted(starts):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = start + length
        else:
            spans.append([start, start + length])
    return [tuple(s) for s in spans]


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows with a passage of at least ``length`` words that another document also has.

    Per row of such a document: ``n_words``, ``n_spans``, ``n_repeated`` (words inside spans) and ``spans``,
    an array of ``start:end`` in words, the longest stretches covered by repeated passages. A row whose
    words all equal another row's is one span. Null, empty and short texts have none.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    documents = durable(documents_of(rows))
    words = documents.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    seeds = durable(repeated_seeds(rows, length, int(words * 4 // length // SLICE_ROWS) + 1))
    shared = spark.sparkContext.broadcast(key_filter(seeds.select(F.col("seed").alias("key")), seeds.count()))
    segments = written(segments_of(rows, length, shared))
    # A segment of two documents settles all its stretches. One of a single document may still share some of them with
    # another segment of the same seed: of such seeds, one or two documents of each segment send their stretches.
    kinds = written(segments.groupBy("segment").agg(F.min("seed").alias("seed"), F.min("node").alias("lo"), F.max("node").alias("hi")))
    of_seed = kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("lo") == F.col("hi")).alias("single"))
    unsettled = written(of_seed.filter("n > 1 AND single").select("seed"))
    senders = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    keys = kinds.join(unsettled, "seed", "left_semi").select("segment", F.explode(senders).alias("node"))
    keys = written(keys.select(F.explode(F.array(F.col("segment").bitwiseXOR(F.col("node")), "node")).alias("key")))
    wanted = spark.sparkContext.broadcast(key_filter(keys, keys.count()))
    stretches = written(stretches_of(rows, length, shared, wanted))
    common = stretches.groupBy("stretch").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("stretch")
    single = stretches.join(common, "stretch").select("node", "start", F.lit(1).alias("size"))
    settled = segments.join(kinds.filter("lo <> hi").select("segment"), "segment").select("node", "start", "size")
    starts = settled.union(single).distinct()
    # The starts of one document are bounded by its own words.
    spans = starts.groupBy("node").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for starts, sizes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                every = [at for start, size in zip(starts, sizes) for at in range(start, start + size)]
                texts.append([f"{a}:{b}" for a, b in joined_spans(every, length)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.string()))], names=["node", "spans"])

    spans = spans.mapInArrow(join, "node long, spans array<string>")
    copies = documents.filter(F.col("n_words") >= length).groupBy("node").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    whole = F.array(F.concat(F.lit("0:"), F.col("n_words").cast("string")))
    found = documents.join(copies, "node", "left").join(spans, "node", "left").select(
        F.col("doc_id").alias(id_col), "n_words", F.when(F.col("c").isNotNull(), whole).otherwise(F.col("spans")).alias("spans")
    )
    size = lambda s: F.element_at(F.split(s, ":"), 2).cast("long") - F.element_at(F.split(s, ":"), 1).cast("long")
    return found.filter("spans IS NOT NULL").select(
        id_col, "n_words", F.size("spans").cast("long").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + size(s)).alias("n_repeated"), "spans",
    )
