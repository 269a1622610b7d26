"""Token distances between two lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("jaccard", "cosine")


def jaccard_distance(a: Column, b: Column) -> Column:
    """Token-set distance of two token arrays; two empty lines are equal."""
    union = F.size(F.array_union(a, b))
    common = F.size(F.array_intersect(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - common / union)


def times(words: Column, token: Column) -> Column:
    return F.size(words) - F.size(F.array_remove(words, token))


def _dot(a: Column, b: Column) -> Column:
    """Sum over common tokens of how often both arrays hold them; without repeats that is their number."""
    common = F.array_intersect(a, b)
    repeats = (F.size(F.array_distinct(a)) < F.size(a)) | (F.size(F.array_distinct(b)) < F.size(b))
    counted = F.aggregate(common, F.lit(0).cast("long"), lambda total, w: total + (times(a, w) * times(b, w)).cast("long"))
    return F.when(repeats, counted).otherwise(F.size(common).cast("long"))


def square(words: Column) -> Column:
    """Sum over tokens of the square of their count."""
    kinds = F.array_distinct(words)
    counts = F.transform(kinds, lambda w: times(words, w).cast("long"))
    counted = F.aggregate(counts, F.lit(0).cast("long"), lambda total, n: total + n * n)
    return F.when(F.size(kinds) < F.size(words), counted).otherwise(F.size(words).cast("long"))


def cosine_distance(a: Column, b: Column, squares: tuple[Column, Column] | None = None) -> Column:
    """Token-count distance of two token arrays; one empty line is at distance 1.

    ``squares`` are those of both arrays, where they are known.
    """
    square_a, square_b = squares or (square(a), square(b))
    norm = F.sqrt(square_a.cast("double")) * F.sqrt(square_b.cast("double"))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(0.0))
        .when(norm == 0, F.lit(1.0))
        .otherwise(1 - _dot(a, b) / norm)
    )


def distance(a: Column, b: Column, metric: str, squares: tuple[Column, Column] | None = None) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return jaccard_distance(a, b) if metric == "jaccard" else cosine_distance(a, b, squares)
