"""N-gram Jaccard join with adaptive multi-match prefixes.

The distinct shingles of a document are ordered, rare ones first. Two documents that link share at least l
of the first n - o + l shingles of each, where o is the overlap that a link needs at least. A document
chooses l by the estimated cost of its candidates: where its prefix is common, the prefix grows and a
candidate has to share more of it before the whole sets are compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logloom.llm.common import fresh, map_rows, ready, whole_text
from logloom.llm.components import connected
from logloom.llm.hashing import as_long, digest, lower_words, mixed, shingle_set
from logloom.session import durable, release

SHINGLE, PERCENT = 4, 85
# Counters of the sketch that orders shingles; their number bounds what is broadcast, not what is counted.
SKETCH_BITS, SKETCH_PARTS = 24, 256
# Lists of a shingle with more documents than this are compared by components instead of by pairs: there the
# prefix is lengthened to the whole set.
SMALL_LIST = 12
# Orders in which longer lists are chained first.
ORDERS = 8
# Rows of one block of a longer list, and shingles of one slice of the prefix index.
BLOCK, SLICE_ROWS = 512, 250_000
# From this class on, the rows of a shingle are spread over several slices.
HOT_CLASS = 16
MAX_MATCHES = 9
FILTER_BITS = 22


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))


def packed_counts(part: np.ndarray) -> bytes:
    """Counters of one part, compressed: all of them, or the places and values of the few that are set."""
    at = np.flatnonzero(part)
    if len(at) * 8 > len(part):
        return b"all." + zlib.compress(part.tobytes(), 1)
    return b"few." + zlib.compress(np.concatenate([at.astype(np.uint32), part[at]]).tobytes(), 1)


def add_counts(total: np.ndarray, packed: bytes) -> None:
    values = np.frombuffer(zlib.decompress(packed[4:]), np.uint32)
    if packed[:4] == b"all.":
        total += values
    else:
        at, counts = np.split(values, 2)
        total[at] += counts


def documents_and_sketch(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, node) per row, and rows (part, counts) of the task's sketch of all shingles.

    ``node`` digests the shingle set in 64 bits: equal sets are one node. It is null for an empty set.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "node", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema[0].type
            sets = [shingle_set(lower_words(raw), size) for raw in batch.column(1).to_pylist()]
            if sets:
                np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            n, none = len(sets), pa.nulls(len(sets), pa.int32())
            nodes = [digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.int64()), none, pa.nulls(n, pa.binary())],
                names=names,
            )
        parts = [(i, part) for i, part in enumerate(np.split(counts, SKETCH_PARTS)) if part.any()]
        for i, part in parts:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([i], pa.int32()),
                    pa.array([packed_counts(part)], pa.binary()),
                ],
                names=names,
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n long, node long, part int, counts binary")


def rarity_classes(parts: DataFrame, shingles: int) -> np.ndarray:
    """Logarithmic class of every counter against the mean, one byte each: a table of fixed size."""
    mean = shingles / (1 << SKETCH_BITS)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64)
        for packed in table.column("counts").to_pylist():
            add_counts(total, packed)
        classes = np.round(np.log2(1 + total / (mean + 1))).astype(np.uint8)
        return pa.table({"part": table.column("part")[:1], "classes": pa.array([classes.tobytes()], pa.binary())})

    found = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for row in parts.select("part", "counts").groupBy("part").applyInArrow(add, "part int, classes binary").toLocalIterator():
        found[row["part"]] = np.frombuffer(row["classes"], np.uint8)
    return found.ravel()


def prefix_of(chosen: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The document's prefix in order, and the number of shingles a candidate must share with it."""
    kinds = classes[(chosen >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((chosen, kinds))
    n, overlap = len(chosen), -(-percent * len(chosen) // 100)
    first = n - overlap + 1
    cost = float(np.where(kinds[order[:first]] >= 3, np.exp2(kinds[order[:first]].astype(np.float64)), 0).mean())
    matches = max(1, min(1 + int(np.log2(1 + cost)), MAX_MATCHES, overlap))
    return chosen[order[: first + matches - 1]], matches


def prefixes(rows: DataFrame, size: int, percent: int, classes) -> DataFrame:
    """(node, n, matches, prefix) per document with shingles; equal nodes repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column(1).to_pylist():
                if len(chosen := shingle_set(lower_words(raw), size)):
                    prefix, matches = prefix_of(chosen, classes.value, percent)
                    found.append((digest(chosen), len(chosen), matches, prefix.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                names=["node", "n", "matches", "prefix"],
            )

    return rows.mapInArrow(run, "node long, n long, matches int, prefix binary")


def distinct_lists(nodes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct runs of the node array as rows of sorted nodes, and how often each occurs; one size at a time."""
    for m in np.unique(sizes):
        at = starts[sizes == m][:, None] + np.arange(m)[None, :]
        yield np.unique(np.sort(nodes[at], axis=1), axis=0, return_counts=True)


def prefix_index(table: DataFrame, slices: int, classes) -> DataFrame:
    """Rows (nodes, shared) of short lists and rows (token, a) of long ones; the other columns are null.

    A short list is the set of documents that have ``shared`` shingles of this slice in their prefixes. Copies of a
    passage give the same list for many shingles, so lists are far fewer than shingles, and at most as many.
    Packed (shingle, node) arrays go to slices of the hash space, whose number follows the input. A shingle
    that the sketch calls hot is spread over slices by its nodes, and its list counts as long.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            pairs = np.concatenate(held)
            kinds = classes.value[(pairs[:, 0] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
            hot = kinds >= HOT_CLASS
            spread = np.where(hot, mixed(pairs[:, 1]) % (np.uint64(1) << np.maximum(kinds - HOT_CLASS + 4, 0).astype(np.uint64)), np.uint64(0))
            target = (mixed(pairs[:, 0] + spread) % np.uint64(slices)).astype(np.int64) * 2 + hot
            order = np.argsort(target, kind="stable")
            pairs, target = pairs[order], target[order]
            edges = np.flatnonzero(np.diff(target, prepend=-1))
            blobs = [part.tobytes() for part in np.split(pairs, edges[1:])]
            for at in range(0, len(blobs), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(target[edges[at : at + 64]], pa.int64()), pa.array(blobs[at : at + 64], pa.binary())], names=["slice", "packed"]
                )

        for batch in batches:
            for node, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = np.frombuffer(prefix, np.uint64)
                held.append(np.stack([tokens, np.full(len(tokens), np.int64(node)).view(np.uint64)], axis=1))
                size += len(tokens)
            if size >= 1_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def lists(table: pa.Table) -> pa.Table:
        hot = table.column("slice")[0].as_py() % 2 == 1
        pairs = np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, 2) for b in table.column("packed").to_pylist()])
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        # A copy of a document repeats its rows.
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        tokens, nodes = pairs[new, 0], as_long(np.ascontiguousarray(pairs[new, 1]))
        starts = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] ^ np.uint64(1)))
        sizes = np.diff(starts, append=len(tokens))
        small = (sizes > 1) & (sizes <= SMALL_LIST) & (not hot)
        found = list(distinct_lists(nodes, starts[small], sizes[small]))
        members = [row for rows, _ in found for row in rows]
        shared = np.concatenate([np.empty(0, np.int64), *(counts for _, counts in found)])
        long_rows = np.repeat((sizes > SMALL_LIST) | hot, sizes)
        k, n = len(members), int(long_rows.sum())
        return pa.table(
            {
                "token": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(as_long(np.ascontiguousarray(tokens[long_rows])))]),
                "a": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(nodes[long_rows])]),
                "nodes": pa.array([*members, *([None] * n)], pa.list_(pa.int64())),
                "shared": pa.concat_arrays([pa.array(shared.astype(np.int64)), pa.nulls(n, pa.int64())]),
            }
        )

    packed = table.select("node", "prefix").mapInArrow(deal, "slice long, packed binary")
    return packed.groupBy("slice").applyInArrow(lists, "token long, a long, nodes array<long>, shared long")


def pairs_of_lists(index: DataFrame) -> DataFrame:
    """(a, b, shared) for the pairs inside short lists; equal lists of all slices are added up before they make pairs."""
    lists = index.filter("token IS NULL").groupBy("nodes").agg(F.sum("shared").alias("shared"))
    first = lists.select("nodes", "shared", F.posexplode("nodes").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("nodes", F.col("i") + 2, F.size("nodes"))).alias("b"), "shared")
    return pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def needed_overlap(n_a, n_b, percent: int):
    return F.ceil(F.lit(percent) * (n_a + n_b) / F.lit(100 + percent))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow a link and that share enough of their prefixes.

    What they share beyond the shorter-reaching prefix is at most the rest of that document.
    """
    side = lambda s: nodes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "matches", "reach")])
    sized = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
    rest = F.greatest(F.col("n_a") - F.col("reach_a"), F.col("n_b") - F.col("reach_b"))
    return sized.filter(
        (F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
        & (F.col("shared") >= F.least("matches_a", "matches_b"))
        & (F.col("shared") + rest >= needed_overlap(F.col("n_a"), F.col("n_b"), percent))
    ).select("a", "b")


def texts_of_nodes(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, packed) of the wanted nodes: the lower-case words of one of their texts, compressed.

    Words take less room than the hashes of their shingles. A bitmap of fixed size tells tasks which
    documents may be wanted; it only saves work, the join decides.
    """
    place = F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(node), {1 << FILTER_BITS}), 64) as int))")
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    words = wanted.select(F.floor(place / 64).cast("int").alias("w"), bit.alias("bit"))
    for row in words.groupBy("w").agg(F.bit_or("bit").alias("bits")).collect():
        bits[row["w"]] = row["bits"]
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(lower_words(raw), size) for raw in batch.column(1).to_pylist()]
            nodes = pa.array([digest(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([nodes, batch.column(1)], names=["node", "text"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = ((shared.value[at >> 6] >> (at & 63)) & 1).astype(bool)
            kept = pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], names=["node", "text"]).filter(pa.array(keep))
            packed = [zlib.compress(b" ".join(lower_words(raw)), 6) for raw in kept.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(packed, pa.binary())], names=["node", "packed"])

    made = rows.mapInArrow(digests, "node long, text binary").filter("node IS NOT NULL").select(place.alias("place"), "node", "text")
    kept = made.mapInArrow(pack, "node long, packed binary")
    return kept.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("packed").alias("packed"))


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    side = lambda s: texts.select(F.col("node").alias(s), F.col("packed").alias(f"packed_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            keep = []
            for a, b, one, other in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for node, packed in ((a, one), (b, other)):
                    if node not in sets:
                        sets[node] = shingle_set(zlib.decompress(packed).split(), size)
                both = np.concatenate([sets[a], sets[b]])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a long, b long")


def chained(long_lists: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Chains of pairs through each long list, in one of a few orders, as far as sizes allow a link.

    Lists of one group have many members in common, so few orders keep the pairs few and still connect them.
    """
    order = F.xxhash64(F.pmod("token", F.lit(ORDERS)), "a")
    rows = long_lists.join(nodes.select(F.col("node").alias("a"), "n"), "a").withColumn("_o", order)
    rows = rows.withColumn("_part", F.pmod(F.floor(F.col("_o") / 64), F.lit(ORDERS)))
    window = "PARTITION BY token, _part ORDER BY _o"
    before = rows.select("a", "n", F.expr(f"lag(a) OVER ({window})").alias("b"), F.expr(f"lag(n) OVER ({window})").alias("m"))
    near = before.filter(F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def across(long_lists: DataFrame, roots: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) inside long lists between documents that are not connected yet.

    Here candidates are dearest, so prefixes are lengthened to the whole sets: what two documents share is
    then exact. The lists are compared in pairs of blocks; each gives links that join its components, at
    most one less than it has documents.
    """
    rooted = long_lists.join(roots.withColumnRenamed("node", "a"), "a", "left").select(
        "token", F.col("a").alias("node"), F.coalesce("root", "a").alias("root")
    )
    open_lists = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"))
    open_lists = open_lists.filter("lo <> hi").select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = rooted.join(open_lists, "token").withColumn("mine", F.pmod(F.xxhash64("node", "token"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", "node", "root", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def compare(part: pa.Table) -> pa.Table:
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        nodes, root, mine = (part.column(c).to_numpy().astype(np.int64) for c in ("node", "root", "mine"))
        found: list[tuple[int, int]] = []
        if len(np.unique(root)) > 1:
            sets = [shingle_set(zlib.decompress(p).split(), size) for p in part.column("packed").to_pylist()]
            n = np.array([len(s) for s in sets])
            tokens, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(sets)), n)
            column = np.cumsum(counts > 1) - 1
            often = counts[place] > 1
            has = np.zeros((len(sets), int((counts > 1).sum())), np.float32)
            has[owner[often], column[place[often]]] = 1
            # Pairs inside the largest component need no look.
            names, sizes = np.unique(root, return_counts=True)
            others = np.flatnonzero(root != names[sizes.argmax()])
            for step in range(0, len(others), 256):
                some = others[step : step + 256]
                products = (has[some] @ has.T).astype(np.int64)
                for at, shared in zip(some, products):
                    similar = (100 * shared >= percent * (n + n[at] - shared)) & (root != root[at])
                    for other in np.flatnonzero(similar & ((mine != mine[at]) if i != j else True)):
                        if root[other] != root[at]:
                            found.append((nodes[at], nodes[other]))
                            root[root == root[other]] = root[at]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.join(texts, "node").groupBy("token", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, node) and links (a, b) between nodes that connect every pair of similar sets.

    Links inside a component that other links already connect may be left out; no two similar sets end up
    in different components.
    """
    spark: SparkSession = ready(docs.sparkSession)
    rows = texts_of(docs, id_col, text_col)
    first = durable(documents_and_sketch(rows, size))
    documents = first.filter("part IS NULL").select("doc_id", "n", "node")
    shingles = documents.agg(F.sum("n").alias("n")).first()["n"] or 0
    classes = spark.sparkContext.broadcast(rarity_classes(first.filter("part IS NOT NULL"), shingles))
    table = durable(prefixes(rows, size, percent, classes))
    total = table.agg(F.sum(F.octet_length("prefix") / 8).alias("n")).first()["n"] or 0
    index = durable(prefix_index(table, int(total // SLICE_ROWS) + 1, classes))
    release(spark)
    nodes = table.select("node", "n", "matches", (F.octet_length("prefix") / 8).cast("long").alias("reach")).distinct()
    pairs = pairs_of_lists(index)
    long_lists = index.filter("token IS NOT NULL").select("token", "a")
    found = durable(likely(pairs, nodes, percent).union(chained(long_lists, nodes, percent)).distinct())
    long_nodes = long_lists.select(F.col("a").alias("node"))
    wanted = durable(found.select(F.col("a").alias("node")).union(found.select("b")).union(long_nodes).distinct())
    # What plans, generated code and tables of a step took goes before the next one, so that they do not add up on the driver.
    del pairs, nodes, table
    release(spark)
    texts = durable(texts_of_nodes(rows, wanted, size))
    del wanted
    release(spark)
    links = durable(verified(found, texts, size, percent))
    del found
    release(spark)
    roots = connected(links)
    more = across(long_lists, roots, texts, size, percent)
    links = durable(links.union(more))
    del more, roots, texts, long_lists, long_nodes, index
    release(spark)
    return documents, links


def grouped(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, node, root, least) per row: its component and the smallest id in it; without words only the id."""
    documents, links = link(docs, size, percent, id_col, text_col)
    roots = connected(links)
    rooted = documents.join(roots, "node", "left").select("doc_id", "n", "node", F.coalesce("root", "node").alias("root"))
    least = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left")


def similar_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Rows without words (null or empty text) link with nothing and keep their own id. Rows with equal sets
    are linked whatever their ids; a null id counts for no component unless all its ids are null.
    """
    return grouped(docs, size, percent, id_col, text_col).select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def with_nodes(docs: DataFrame, size: int, text_col: str, name: str) -> DataFrame:
    """All rows and columns, and the node as in ``documents_and_sketch`` under a ``name`` of its own."""
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(position).to_pylist()]
            sets = [shingle_set(lower_words(raw), size) for raw in texts]
            nodes = pa.array([digest(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, name])

    return map_rows(docs, run, [StructField(name, LongType())])


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, in all columns, of the smallest id of each group; rows without words or without an id all stay.

    Where that id repeats in a group, the row with the smallest text stays. An id may stand in several groups. Columns
    of the table may have any names.
    """
    words = durable(grouped(docs, size, percent, id_col, text_col).filter(F.col("n") > 0).filter("doc_id IS NOT NULL"))
    gone_id, again_id, node, stay_id, stay_node, root, row = (
        fresh(docs.columns, name) for name in ("_gone", "_again", "_node", "_id", "_n", "_root", "_row")
    )
    again = durable(words.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(again_id)))
    gone = words.filter("doc_id <> least").select(F.col("doc_id").alias(gone_id)).distinct()
    told = whole_text(text_col).rlike(r"[^\x20\x09-\x0D]")
    mine = docs[id_col]
    if again.isEmpty():
        return docs.join(gone, (mine == F.col(gone_id)) & told, "left_anti")
    # Repeated ids are decided row by row; the others, as above, by the id.
    once = docs.join(gone.union(again).distinct(), (mine == F.col(gone_id)) & told, "left_anti")
    rows = with_nodes(docs.filter(told).join(again, mine == F.col(again_id), "left_semi"), size, text_col, node)
    stay = words.filter("doc_id = least").select(
        F.col("doc_id").alias(stay_id), F.col("node").alias(stay_node), F.col("root").alias(root)
    ).distinct()
    rows = rows.join(stay, (rows[id_col] == F.col(stay_id)) & (F.col(node) == F.col(stay_node)))
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(text_col)).alias(row)
    kept = rows.groupBy(root).agg(first)
    return once.union(kept.select(*[F.col(row)[c].alias(c) for c in docs.columns]))
