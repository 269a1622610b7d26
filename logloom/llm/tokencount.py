"""Exact byte-pair token counts: most pre-tokens are whole tokens, and only the rest are merged."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Shared, map_texts, ready

# The white space and the pre-token pattern of byte-level BPE.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
# No pre-token crosses the edge of such a unit, so counts of units add up to the text's count.
UNIT = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
CACHED_STRINGS = 500_000
# Bytes from which a pre-token is merged by a heap instead of by looking for the lowest pair each time.
LONG_WORD = 200


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Merges:
    """Numbers of tokens: of each byte, and of what each merge makes, and the rank of the merge of a pair of numbers."""

    single: list[int]
    ranks: dict[int, int]
    made: list[int]

    def pieces(self, word: bytes) -> int:
        """Tokens of one pre-token: the pair of lowest rank joins first, the leftmost among equals."""
        if len(word) > LONG_WORD:
            return self.pieces_of_long(word)
        parts = [self.single[b] for b in word]
        rank_of, none = self.ranks.get, len(self.made)
        known = [rank_of(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while known and (rank := min(known)) < none:
            at = known.index(rank)
            parts[at] = self.made[rank]
            del parts[at + 1], known[at]
            # Only the pairs on both sides of the new part are others than before.
            if at:
                known[at - 1] = rank_of(parts[at - 1] << 32 | parts[at], none)
            if at < len(known):
                known[at] = rank_of(parts[at] << 32 | parts[at + 1], none)
        return len(parts)


    def pieces_of_long(self, word: bytes) -> int:
        """The same by a heap of pairs over linked parts: a pre-token of any length takes n log n steps."""
        parts = [self.single[b] for b in word]
        size, rank_of = len(parts), self.ranks.get
        after, before, left = list(range(1, size + 1)), list(range(-1, size - 1)), size
        heap = [(r, i) for i in range(size - 1) if (r := rank_of(parts[i] << 32 | parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, at = heappop(heap)
            other = after[at]
            # A pair that one of its parts has left since is no pair any more.
            if parts[at] < 0 or other >= size or rank_of(parts[at] << 32 | parts[other]) != rank:
                continue
            parts[at], parts[other] = self.made[rank], -1
            after[at] = after[other]
            if after[at] < size:
                before[after[at]] = at
            left -= 1
            for first in (before[at], at):
                if first >= 0 and after[first] < size and (r := rank_of(parts[first] << 32 | parts[after[first]])) is not None:
                    heappush(heap, (r, first))
        return left


def numbered_merges(pairs: list[tuple[bytes, bytes]]) -> Merges:
    numbers = {bytes([b]): b for b in range(256)}
    for a, b in pairs:
        numbers.setdefault(a + b, len(numbers))
    ranks = {numbers[a] << 32 | numbers[b]: i for i, (a, b) in enumerate(pairs)}
    return Merges(list(range(256)), ranks, [numbers[a + b] for a, b in pairs])


@dataclass(frozen=True)
class Vocabulary:
    """Merges, the strings proven to be one token alone, and the special strings."""

    merges: Merges
    whole: frozenset[bytes]
    specials: tuple[str, ...]


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a tokenizer file and proves, string by string, which ones encode alone as one token."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    letters = byte_letters()
    raw = lambda text: bytes(letters[c] for c in text)
    pairs = [p.split(" ") if isinstance(p, str) else p for p in content["model"]["merges"]]
    merges = numbered_merges([(raw(a), raw(b)) for a, b in pairs])
    specials = tuple(t["content"] for t in content["added_tokens"])
    strings = [raw(s) for s in content["model"]["vocab"] if s not in specials]
    return Vocabulary(merges, frozenset(s for s in strings if merges.pieces(s) == 1), specials)


class Remembered(dict):
    """What a function gives for a string, worked out once while it is remembered; long strings are not."""

    def __init__(self, function) -> None:
        self.function = function

    def __missing__(self, text: str) -> int:
        found = self.function(text)
        if len(self) >= CACHED_STRINGS:
            self.clear()
        if len(text) <= 64:
            self[text] = found
        return found


def unit_counter(vocabulary: Vocabulary) -> Remembered:
    """Tokens of a unit: whole pre-tokens count one, only the rest is merged."""
    whole, merges, pre_tokens = vocabulary.whole, vocabulary.merges, regex.compile(PRE_TOKEN).findall

    def tokens(pre_token: str) -> int:
        word = pre_token.encode()
        return 1 if word in whole else merges.pieces(word)

    known = Remembered(tokens)
    return Remembered(lambda unit: sum([known[p] for p in pre_tokens(unit)]))


def text_counter(vocabulary: Vocabulary):
    """A function from a text to its number of tokens; special strings inside count as one token."""
    units, counts = re.compile(UNIT), unit_counter(vocabulary)
    special = re.compile("|".join(map(re.escape, vocabulary.specials))) if vocabulary.specials else None

    def count(text: str) -> int:
        parts = special.split(text) if special else [text]
        return len(parts) - 1 + sum(sum(map(counts.__getitem__, units.findall(part))) for part in parts)

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of each whole text, and whether the tokens exceed ``limit``.

    A null or empty text has none. One row per input row, repeated ids included. Texts and pre-tokens of any length
    are counted whole; other columns are not read.
    """
    shared = Shared(ready(docs.sparkSession), load_vocabulary(path))

    def make():
        count = shared.made("counter", text_counter)
        return lambda texts: {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": [count(t) for t in texts]}

    found = map_texts(docs, {"n_bytes": "long", "n_tokens": "long"}, make, id_col, text_col)
    return found.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
