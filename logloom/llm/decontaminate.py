"""Benchmark decontamination with a generalised suffix automaton over the words of all items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from logloom.llm.common import Shared, bounded_rows, ready, whole_text
from logloom.session import durable

WINDOW = 13
# Fixed value: words of the contract, after A-Z became lower case; here on UTF-8 bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Words of one automaton. More items make more automata, each a pass of its own over the documents.
BLOCK_WORDS = 100_000
# Rows of the item table that may come to the driver.
MAX_ITEMS = 1_000_000


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class ItemAutomaton:
    """Suffix automaton of many word sequences; every state knows the items it occurs in.

    ``items`` are (id as text, words). A window is ``window`` consecutive words, or a whole shorter item.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        held: list[set[int]] = [set()]
        sequences = []
        for number, (_, words) in enumerate(items):
            ids = [self.vocab.setdefault(word, len(self.vocab)) for word in words]
            sequences.append(ids)
            state = 0
            for word in ids:
                state = self._extend(state, word)
                while len(held) < len(self.length):
                    held.append(set())
                held[state].add(number)
        while len(held) < len(self.length):
            held.append(set())
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(order):
            if self.link[state] > 0:
                held[self.link[state]] |= held[state]
        # Per state: items of its window-long suffix, and (length, item) of whole short items that end there.
        self.full: list[tuple[int, ...]] = [()] * len(self.length)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        ends: dict[int, list[tuple[int, int]]] = {}
        for number, ids in enumerate(sequences):
            if 0 < len(ids) < window:
                state = 0
                for word in ids:
                    state = self.next[state][word]
                ends.setdefault(state, []).append((len(ids), number))
        for state in order:
            link = self.link[state]
            if self.length[link] >= window:
                self.full[state] = self.full[link]
            elif self.length[state] >= window:
                self.full[state] = tuple(sorted(held[state]))
            self.short[state] = (*self.short[link], *ends.get(state, ()))
        self.names = [name for name, _ in items]
        sizes = [min(len(ids), window) for ids in sequences if ids]
        self.least = min(sizes, default=0)
        pairs = {a * len(self.vocab) + b for ids in sequences for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _new(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state for the words of ``state`` and this word alone, parted from the longer ones of ``target``."""
        if self.length[target] == self.length[state] + 1:
            return target
        part = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = part
        while state != -1 and self.next[state].get(word) == target:
            self.next[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, state: int, word: int) -> int:
        if word in self.next[state]:
            return self._split(state, word, self.next[state][word])
        made = self._new(self.length[state] + 1, {}, 0)
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = made
            state = self.link[state]
        if state != -1:
            self.link[made] = self._split(state, word, self.next[state][word])
        return made

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches long enough for a window in which every word pair occurs in some item."""
        if not self.least or len(ids) < self.least:
            return
        if self.least == 1:
            known = ids >= 0
            edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
            yield from zip(edges[::2].tolist(), edges[1::2].tolist())
            return
        codes = ids[:-1] * len(self.vocab) + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        known = (self.pairs[at] == codes) & (ids[:-1] >= 0) & (ids[1:] >= 0)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start + 1 >= self.least:
                yield start, end + 1

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans covered by windows (merged, in order) and the items whose windows occur."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for start, end in self.stretches(ids):
            state = length = 0
            for place, word in enumerate(ids[start:end].tolist(), start + 1):
                while state and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if word in self.next[state]:
                    state, length = self.next[state][word], length + 1
                reach = 0
                if length >= self.window:
                    reach = self.window
                    items.update(self.full[state])
                for size, item in self.short[state]:
                    if size <= length:
                        reach = max(reach, size)
                        items.add(item)
                if reach:
                    first = place - reach
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, place))
        return spans, items


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> list[list[tuple[str, list[bytes]]]]:
    """The items with words, as blocks of a bounded number of words; equal rows count once."""
    rows = items.select(F.col(id_col).cast("string").alias("i"), whole_text(text_col).alias("t")).distinct()
    blocks, size = [[]], 0
    for row in sorted(bounded_rows(rows, MAX_ITEMS, "the item table"), key=lambda r: (r["i"] or "", r["t"])):
        words = words_of(row["t"])
        if not words or row["i"] is None:
            continue
        if size and size + len(words) > block_words:
            blocks.append([])
            size = 0
        blocks[-1].append((row["i"], words))
        size += len(words)
    return blocks


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def find_overlaps(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per document: ``n_words``, word spans of item windows (``start:end``) and the ids of their items.

    Null and empty texts have no words. Items without words or id match nothing. Every document gives one
    row. With several blocks of items, what earlier blocks found travels with the text.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text")).select(
        id_col, "text", F.array().cast("array<string>").alias("spans"), F.array().cast("array<string>").alias("items")
    )
    kind = rows.schema[0].dataType.simpleString()
    blocks = item_blocks(items, item_id, item_text, block_words)
    for number, block in enumerate(blocks):
        shared = Shared(spark, ItemAutomaton(block, window))
        last = number == len(blocks) - 1

        def run(batches, shared=shared, last=last):
            automaton = shared.value
            for batch in batches:
                spans, found, counts = [], [], []
                old = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
                for text, old_spans, old_items in old:
                    words = words_of(text)
                    new, which = automaton.matches(words)
                    if old_spans:
                        new = merge_spans([*new, *(tuple(map(int, s.split(":"))) for s in old_spans)])
                    counts.append(len(words))
                    spans.append([f"{a}:{b}" for a, b in new])
                    found.append(sorted({*(old_items or ()), *(automaton.names[i] for i in which)}))
                lists = [pa.array(x, pa.list_(pa.string())) for x in (spans, found)]
                first = pa.array(counts, pa.int64()) if last else batch.column(1)
                names = [id_col, "n_words" if last else "text", "spans", "items"]
                yield pa.RecordBatch.from_arrays([batch.column(0), first, *lists], names=names)

        middle = "n_words long" if last else "text string"
        rows = rows.mapInArrow(run, f"`{id_col}` {kind}, {middle}, spans array<string>, items array<string>")
        if not last:
            rows = durable(rows)
    return rows


def judge(found: DataFrame, id_col: str = "doc_id", percent: int = 5) -> DataFrame:
    """Digest of the overlaps: hit words, items, and whether they reach ``percent`` of the words."""
    size = lambda s: F.element_at(F.split(s, ":"), 2).cast("long") - F.element_at(F.split(s, ":"), 1).cast("long")
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + size(s))
    return found.select(
        id_col, "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hits > 0) & (F.lit(100) * hits >= F.lit(percent) * F.col("n_words"))).alias("contaminated"),
    )


def after_all_blocks(
    docs: DataFrame, items: DataFrame, window: int, block_words: int, text_col: str,
    finish: Callable[[pa.RecordBatch, list[list[tuple[int, int]]]], pa.RecordBatch],
) -> DataFrame:
    """What ``finish`` makes of the rows, in all columns, and the merged word spans of all blocks of items.

    With several blocks, what earlier blocks found travels with the rows; the texts stay as they are until
    the last block.
    """
    spark = ready(docs.sparkSession)
    position, width = docs.columns.index(text_col), len(docs.columns)
    names = docs.columns
    # Plain names meanwhile: those of the table may hold dots, or be the one of the spans.
    docs = docs.toDF(*[f"c{i}" for i in range(width)])
    schema = docs.schema
    carried = StructType([*schema.fields, StructField("spans", ArrayType(LongType()))])
    blocks = item_blocks(items, "item_id", "text", block_words)
    for number, block in enumerate(blocks):
        shared = Shared(spark, ItemAutomaton(block, window))
        last = number == len(blocks) - 1

        def run(batches, shared=shared, first=number == 0, last=last):
            for batch in batches:
                spans = [shared.value.matches(words_of(t or ""))[0] for t in batch.column(position).to_pylist()]
                if not first:
                    old = batch.column(width).to_pylist()
                    spans = [merge_spans([*new, *zip(o[::2], o[1::2])]) if o else new for new, o in zip(spans, old)]
                rows = batch.select(range(width))
                if last:
                    yield finish(rows, spans)
                else:
                    flat = pa.array([[x for span in s for x in span] for s in spans], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, flat], names=[*rows.schema.names, "spans"])

        docs = docs.mapInArrow(run, schema if last else carried)
        if not last:
            docs = durable(docs)
    return docs.toDF(*names)


def drop_contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 5, text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows, in all columns, whose hit words stay below ``percent`` of their words."""
    position = docs.columns.index(text_col)

    def finish(rows, spans):
        hits = [sum(end - start for start, end in s) for s in spans]
        texts = rows.column(position).to_pylist()
        return rows.filter(pa.array([not n or 100 * n < percent * len(words_of(t)) for n, t in zip(hits, texts)], pa.bool_()))

    return after_all_blocks(docs, items, window, block_words, text_col, finish)


def cut_spans(text: str, spans: list[tuple[int, int]], longest: int) -> str:
    """The text without the word spans longer than ``longest`` words, and without the stretch inside them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.lower())]
    parts, done = [], 0
    for start, end in spans:
        if end - start > longest:
            parts.append(raw[done : places[start][0]])
            done = places[end - 1][1]
    return b"".join([*parts, raw[done:]]).decode("utf-8", "surrogatepass")


def remove_spans(
    docs: DataFrame, items: DataFrame, longest: int = WINDOW - 1, window: int = WINDOW, text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All rows and columns, with spans of more than ``longest`` matching words cut from the texts; null stays null."""
    position = docs.columns.index(text_col)

    def finish(rows, spans):
        texts = [t if t is None else cut_spans(t, s, longest) for t, s in zip(rows.column(position).to_pylist(), spans)]
        columns = list(rows.columns)
        columns[position] = pa.array(texts, rows.schema[position].type)
        return pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return after_all_blocks(docs, items, window, block_words, text_col, finish)


def digest_of(items: list[str]) -> str:
    """Lowercase hex of the ids in string order, as ``judge`` gives it; for tests and callers outside Spark."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
