"""SentencePiece encoding and decoding: an Aho-Corasick automaton over pieces drives one pass per unit.

The automaton's output links give, at each position, all pieces that end there. A piece is taken if it
may follow the best piece of the position where it starts; for a BPE model exactly one may, the one with
which the two pieces together encode to themselves. So the pass gives the library's own pieces, which a
sum of the model's scores (they are merge ranks) would not.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from logloom.llm.common import Shared, map_texts, ready

SPACE = "▁"
# No piece has a space mark after another letter, so no piece crosses the edge of a unit.
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
# Bounds of what a task remembers: ids of units, of at most 64 letters each, and verdicts on neighbours.
CACHED_UNITS, CACHED_PAIRS = 600_000, 400_000
# Parts from which a text is merged by a heap instead of by looking for the best pair each time.
LONG_UNIT = 48
UNKNOWN = -1


@dataclass(frozen=True)
class PieceTable:
    """Pieces that text can match with their ids and scores, and the ids of the 256 bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    texts: tuple[str, ...]
    byte_ids: tuple[int, ...]


def load_pieces(path: str) -> PieceTable:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = tuple(model.id_to_piece(i) for i in range(model.vocab_size()))
    matched = [i for i in range(len(texts)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    byte_ids = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    return PieceTable({texts[i]: i for i in matched}, {texts[i]: model.get_score(i) for i in matched}, texts, byte_ids)


class UnitIds(dict):
    """Packed ids of a unit, worked out once while it is remembered."""

    def __init__(self, work) -> None:
        self.work = work

    def __missing__(self, unit: str) -> bytes:
        packed = self.work(unit)
        if len(self) >= CACHED_UNITS:
            self.clear()
        if len(unit) <= 64:
            self[unit] = packed
        return packed


class Encoder:
    """Encodes and decodes texts; ids of units and verdicts on neighbours are remembered within a bound."""

    def __init__(self, table: PieceTable) -> None:
        self.table = table
        self.automaton = ahocorasick.Automaton()
        for piece, number in table.ids.items():
            self.automaton.add_word(piece, (number, len(piece)))
        self.automaton.make_automaton()
        self.units = UnitIds(self.unit_ids)
        raw = [text.encode() for text in table.texts]
        for byte, number in enumerate(table.byte_ids):
            raw[number] = bytes([byte])
        self.raw = raw
        self.neighbours: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces by the model's definition: the best-scored neighbours join first, leftmost among equals."""
        if len(text) > LONG_UNIT:
            return self.merge_long(text)
        scores, parts = self.table.scores, list(text)
        while len(parts) > 1:
            joined = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
            if not joined:
                break
            at = min(joined)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merge_long(self, text: str) -> list[str]:
        """The same by a heap of pairs over linked parts: runs of any length take n log n steps."""
        score, parts, size = self.table.scores.get, list(text), len(text)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(-s, i, parts[i] + parts[i + 1]) for i in range(size - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, at, joined = heappop(heap)
            other = after[at]
            # A pair that one of its parts has left since is no pair any more.
            if not parts[at] or other >= size or len(parts[at]) + len(parts[other]) != len(joined):
                continue
            parts[at], parts[other] = joined, ""
            after[at] = after[other]
            if after[at] < size:
                before[after[at]] = at
            for first in (before[at], at):
                if first >= 0 and after[first] < size and (s := score(pair := parts[first] + parts[after[first]])) is not None:
                    heappush(heap, (-s, first, pair))
        return [part for part in parts if part]

    def may_follow(self, before: int, piece: int) -> bool:
        """Whether a piece may stand after another (or first, or after an unknown letter)."""
        parts = [self.table.texts[n] for n in (before, piece) if n != UNKNOWN]
        return self.merge("".join(parts)) == parts

    def pass_over(self, unit: str) -> list[tuple[int, int]]:
        """(end, piece) along the best path; an unknown letter is a step of its own.

        The automaton gives the pieces that end at each position, from left to right. A position takes the first one
        that may follow the piece which its start has taken; that verdict is remembered per pair.
        """
        size, known = len(unit), self.neighbours
        last, step = [UNKNOWN] * (size + 1), [0] * (size + 1)
        for end, (piece, length) in self.automaton.iter(unit):
            end += 1
            if step[end]:
                continue
            before = last[end - length]
            key = (before << 32) + piece
            verdict = known.get(key)
            if verdict is None:
                if len(known) >= CACHED_PAIRS:
                    known.clear()
                verdict = known[key] = self.may_follow(before, piece)
            if verdict:
                last[end], step[end] = piece, length
        path, end = [], size
        while end:
            path.append((end, last[end]))
            end -= step[end] or 1
        path.reverse()
        return path

    def unit_ids(self, unit: str) -> bytes:
        if SPACE * 2 in unit:  # runs of spaces have equal scores, which only the definition orders
            ends, end = [], 0
            for part in self.merge(unit):
                end += len(part)
                ends.append((end, self.table.ids.get(part, UNKNOWN)))
        else:
            ends = self.pass_over(unit)
        ids = array("i", [piece for _, piece in ends])
        if UNKNOWN in ids:
            ids = array("i")
            for end, piece in ends:
                ids.extend([piece] if piece != UNKNOWN else [self.table.byte_ids[b] for b in unit[end - 1].encode("utf-8", "surrogatepass")])
        return ids.tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Piece ids of a whole text; an empty text has none."""
        if not text:
            return np.empty(0, np.int32)
        units = UNIT.findall(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.units.__getitem__, units)), np.int32)

    def decode(self, ids) -> str:
        """The text of piece ids: bytes are joined, space marks become spaces, the added first one goes."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.decode("utf-8", "replace").replace(SPACE, " ")[1:]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Piece ids of each whole text, one row per input row: ``n_pieces``, ``piece_ids`` and ``n_byte_pieces``.

    A null or empty text has no pieces; texts of any length are encoded whole, runs of spaces included. Repeated
    rows give repeated results, and other columns are not read. The letter U+2581 of a text reads as a space, as in the library.
    """
    shared = Shared(ready(docs.sparkSession), load_pieces(path))

    def make():
        encoder = shared.made("encoder", Encoder)
        low, high = min(shared.value.byte_ids), max(shared.value.byte_ids)

        def work(texts):
            ids = [encoder.encode(t) for t in texts]
            return {
                "n_pieces": [len(x) for x in ids], "piece_ids": ids,
                "n_byte_pieces": [int(((x >= low) & (x <= high)).sum()) for x in ids],
            }

        return work

    return map_texts(docs, {"n_pieces": "long", "piece_ids": "array<int>", "n_byte_pieces": "long"}, make, id_col, text_col)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """Texts of piece ids, one row per input row; null or no ids give an empty text."""
    shared = Shared(ready(encoded.sparkSession), load_pieces(path))
    rows = encoded.select(id_col, encoded[ids_col].alias("ids"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        encoder = shared.made("encoder", Encoder)
        for batch in batches:
            texts = [encoder.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: pieces, the CRC-32 of their ids as little-endian 32-bit numbers, and whether decoding gives the text."""
    shared = Shared(ready(docs.sparkSession), load_pieces(path))

    def make():
        encoder = shared.made("encoder", Encoder)

        def work(texts):
            ids = [encoder.encode(t) for t in texts]
            return {
                "n_pieces": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<i4").tobytes()) for x in ids],
                "decoded": [encoder.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(ids, texts)],
            }

        return work

    return map_texts(docs, {"n_pieces": "long", "ids_crc32": "long", "decoded": "boolean"}, make, id_col, text_col)
