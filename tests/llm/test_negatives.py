"""Hard negatives against all products, and the ranges against all cosines."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, pos string, block string, stripe string, anchor string, `all` string, n string, id string"
EXTRA = ("p", "b", "s", "a", "x", "n", "i")


def by_force(rows, every, n_pos=5, n_neg=10, low=30, high=90):
    part = []
    for vec_id, vector, label, *_ in rows:
        if None not in (vec_id, vector, label) and all(x is not None and math.isfinite(x) for x in vector):
            part.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = Counter()
    for vec_id, label, vector in part:
        if vec_id % every:
            continue
        scored = [(-sum(x * y for x, y in zip(vector, v)), i, other) for i, other, v in part if i != vec_id]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:n_pos]:
            fits = sorted(r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s)[:n_neg]
            for rank, (score, i, _) in enumerate(fits, 1):
                out[(vec_id, p, rank, i, -s, -score)] += 1
    return out


def found(frame):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


def vectors(rng, n, dim, groups):
    """Vectors near a few directions, of unequal lengths, with many copies of one of them."""
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    rows = []
    for i in range(n):
        group = rng.randrange(groups)
        scale = rng.choice([0.1, 1.0, 3.0])
        row = centres[0] if i % 3 == 0 else [scale * (x + rng.gauss(0, 0.3)) for x in centres[group]]
        rows.append((i, row, group % 4, *EXTRA))
    return rows


@pytest.mark.parametrize("dim, groups", [(6, 3), (24, 8)])
def test_mine_equals_all_products(spark, monkeypatch, dim, groups):
    monkeypatch.setattr(negatives, "STRIPE_ROWS", 70)
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 16)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 9)
    rng = random.Random(dim)
    rows = vectors(rng, 300, dim, groups)
    nothing = [(400, None, 1), (410, [1.0] * dim, None), (None, [1.0] * dim, 1), (420, [None] * dim, 1), (430, [float("nan")] * dim, 2)]
    nothing += [(440, [float("inf")] + [0.0] * (dim - 1), 2), (450, [], 1), (460, [0.0] * dim, 2), (470, [1.5], 3), (480, [-2.0] * dim, 77)]
    rows += [(*r, *EXTRA) for r in nothing]
    rows += [rows[1], rows[2], rows[2]]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(negatives.mine(frame, F.col("vec_id") % 10 == 0)) == by_force(rows, 10)


def test_few_rows_other_types_and_huge_numbers(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 1.0], 2), (3, [0.4, 1.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label long")
    assert found(negatives.mine(frame, F.col("vec_id") == 0)) == by_force([(*r, *EXTRA) for r in rows], 5)
    assert negatives.mine(frame, F.col("vec_id") == 9).count() == 0
    assert negatives.mine(frame.limit(0), F.lit(True)).count() == 0
    huge = [(0, [3e9, 1.0], 1), (1, [3e9, 1.0], 1), (2, [1e9, 1.0], 2), (3, [1e30, 1.0], 2)]
    frame = spark.createDataFrame(huge, "vec_id int, embedding array<double>, label long")
    scores = {(r["positive_score"], r["negative_id"]) for r in negatives.mine(frame, F.col("vec_id") < 2, low=0, high=100).collect()}
    # 256 * 3e9 squared is beyond a long, so both stop at its end.
    assert scores == {(negatives.LONG.max, 2), (negatives.LONG.max, 3)}


def test_ranges_lose_no_row_and_leave_rows_out():
    rng = np.random.default_rng(5)
    vectors = np.floor(256 * (np.repeat(rng.normal(size=(8, 12)), 40, axis=0) + 0.2 * rng.normal(size=(320, 12)))).astype(np.int64)
    lengths = negatives.lengths_of(vectors)
    order = np.argsort(-lengths)
    vectors, lengths = vectors[order], lengths[order]
    bucket = negatives.Bucket(np.arange(320), np.zeros(320), vectors, lengths)
    left = 0
    for query in vectors[::17]:
        direction = query / np.linalg.norm(query)
        focus = np.argsort(-np.abs(direction))[: negatives.FOCUS]
        cosines = vectors @ direction / lengths
        for least in (0.1, 0.5, 0.8, 0.95, 1.0):
            rows = bucket.candidates(direction, focus, least)
            want = set(np.flatnonzero(cosines >= least).tolist())
            got = set(range(320)) if rows is None else set(rows.tolist())
            assert want <= got
            if least == 0.8:
                left += len(got)
    assert left < 0.5 * 320 * len(vectors[::17])
