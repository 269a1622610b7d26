"""Hashes of words and word sequences as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def lower_words(raw: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z as lower case; other letters stay."""
    return raw.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * MIX_1
    values = (values ^ (values >> np.uint64(27))) * MIX_2
    return values ^ (values >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; none if there are fewer."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    # The hash of a + b words is the hash of the first a times PRIME ** b, plus that of the next b: as many steps as
    # ``size`` has bits, from the highest on.
    total, width = hashes, 1
    for bit in bin(size)[3:]:
        total = total[:-width] * np.uint64(pow(int(PRIME), width, 1 << 64)) + total[width:]
        width *= 2
        if bit == "1":
            total = total[:-1] * PRIME + hashes[width:]
            width += 1
    return mixed(total + np.uint64(size))


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, an empty one has none."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(size, len(words))))


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def digest(values: np.ndarray) -> int:
    """A signed 64-bit digest of a whole array."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).astype(np.int64))
