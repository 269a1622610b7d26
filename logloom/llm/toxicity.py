"""Toxicity: a linear classifier whose scores may not change when identity terms are swapped."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import bounded_rows, held_out, keep_rows, map_texts, ready, whole_text
from logloom.session import durable

WORD = re.compile(rb"[a-z\x80-\xff]+")
# Neutral mentions of groups, each list being one axis of terms that can stand for one another.
IDENTITY_TERMS = (
    ("men", "women"), ("man", "woman"), ("he", "she"), ("christian", "muslim", "jewish", "hindu", "atheist"),
    ("christians", "muslims", "jews", "hindus", "atheists"), ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual"), ("immigrants", "natives"), ("disabled", "abled"),
)


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that the classifier is fitted on, ``max_terms`` its features."""

    max_rows: int = 8_000
    max_terms: int = 1_000
    min_rows: int = 5
    min_chi: float = 30.0
    ridge: float = 1.0
    swap_weight: float = 50.0
    steps: int = 25
    identity: tuple[tuple[str, ...], ...] = field(default=IDENTITY_TERMS)


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: str) -> float:
        words = set(WORD.findall(text.encode("utf-8", "surrogatepass").lower()))
        total = self.bias + sum(self.weights[w] for w in self.weights.keys() & words)
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -60, 60))))


def terms_of(text: str) -> set[bytes]:
    return set(WORD.findall(text.encode("utf-8", "surrogatepass").lower()))


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled documents outside the held-out fifth.

    The rows are those of smallest hash, so the sample does not depend on order. Several labels of one
    document count as toxic if one is; rows without label or id are left out.
    """
    one = labels.select("doc_id", "toxic").dropna().filter(~held_out(F.col("doc_id")))
    one = one.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    texts = docs.select("doc_id", whole_text().alias("text"))
    # The chosen ids number max_rows at most, which bounds what is broadcast.
    found = texts.join(F.broadcast(chosen), "doc_id")
    # Of a repeated id one text counts, so that the rows are bounded as the ids are.
    one_text = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return found.groupBy("doc_id", F.col("_toxic").alias("toxic")).agg(one_text).select("doc_id", "text", "toxic")


def choose_terms(sample: DataFrame, n_rows: int, n_toxic: int, settings: Settings) -> dict[str, float]:
    """The words whose presence differs most between the classes, with their chi-square over the sample."""
    each = map_texts(
        sample.select(F.col("toxic").alias("label"), "text"), {"terms": "array<string>"},
        lambda: lambda texts: {"terms": [[w.decode("utf-8", "replace") for w in terms_of(t)] for t in texts]}, "label",
    )
    counts = each.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b")
    )
    rest_a, rest_b = F.lit(float(n_toxic)) - F.col("a"), F.lit(float(n_rows - n_toxic)) - F.col("b")
    spread = (F.col("a") * rest_b - F.col("b") * rest_a) ** 2
    seen = F.col("a") + F.col("b")
    chi = F.lit(float(n_rows)) * spread / F.greatest(seen * (n_rows - seen) * n_toxic * (n_rows - n_toxic), F.lit(1.0))
    strong = counts.filter(seen >= settings.min_rows).withColumn("chi", chi).filter(F.col("chi") >= settings.min_chi)
    ranked = strong.orderBy(F.desc("chi"), "term").limit(settings.max_terms)
    return {row["term"]: row["chi"] for row in ranked.select("term", "chi").collect()}


def swap_rows(present: np.ndarray, terms: list[bytes], identity: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Feature changes of the sentences' counterfactuals: each identity term replaced by the next of its axis."""
    place = {term: i for i, term in enumerate(terms)}
    changes = []
    for axis in identity:
        for one, other in zip(axis, (*axis[1:], axis[0])):
            a, b = place.get(one.encode()), place.get(other.encode())
            if a is None and b is None:
                continue
            has = present[:, a] > 0 if a is not None else np.zeros(len(present), bool)
            for with_other in (False, True):
                kept = has & ((present[:, b] > 0) == with_other) if b is not None else has
                if n := int(kept.sum()):
                    change = np.zeros(len(terms))
                    if a is not None:
                        change[a] = -1
                    if b is not None and not with_other:
                        change[b] = 1
                    changes.append(np.sqrt(n) * change)
    return np.array(changes).reshape(-1, len(terms))


def fit_weights(
    present: np.ndarray, toxic: np.ndarray, swaps: np.ndarray, ridge: np.ndarray, settings: Settings
) -> tuple[np.ndarray, float]:
    """Newton steps on logistic loss, a ridge per term, and the squared score changes of the counterfactuals.

    Loss and changes are both sums over rows, so a counterfactual weighs the same against a label at every size.
    """
    n, k = present.shape
    x = np.hstack([present, np.ones((n, 1))])
    penalty = np.diag(np.r_[ridge, 1e-6])
    penalty[:k, :k] += settings.swap_weight * swaps.T @ swaps
    w = np.zeros(k + 1)
    w[k] = np.log((toxic.sum() + 1) / (n - toxic.sum() + 1))
    for _ in range(settings.steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - toxic) + penalty @ w
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(k + 1)
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-4:
            break
    return w[:k], float(w[k])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The classifier of a bounded labelled sample; without labels of both classes it scores the base rate."""
    ready(docs.sparkSession)
    sample = durable(labelled_sample(docs, labels, settings))
    counts = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    n_rows, n_toxic = sum(counts.values()), counts.get(1, 0)
    if not n_toxic or n_toxic == n_rows:
        return Model({}, float(np.log((n_toxic + 1) / (n_rows - n_toxic + 2))))
    identity = {term for axis in settings.identity for term in axis}
    chi = choose_terms(sample, n_rows, n_toxic, settings)
    names = list(dict.fromkeys([*chi, *sorted(identity)]))
    terms = [t.encode() for t in names]
    # The stronger the evidence for a term, the less its weight is held back.
    ridge = settings.ridge * np.array([(settings.min_chi / max(chi.get(t, 0.0), settings.min_chi)) ** 2 for t in names])
    place = {term: i for i, term in enumerate(terms)}

    def make():
        def work(texts):
            return {"at": [sorted(place[w] for w in place.keys() & terms_of(t)) for t in texts]}

        return work

    found = map_texts(sample.select(F.struct("doc_id", "toxic").alias("row"), "text"), {"at": "array<int>"}, make, "row")
    rows = bounded_rows(found.select("row.doc_id", "row.toxic", "at"), settings.max_rows, "the labelled sample")
    rows.sort(key=lambda r: (r["doc_id"], r["at"]))
    present = np.zeros((len(rows), len(terms)), np.float64)
    for i, row in enumerate(rows):
        present[i, row["at"]] = 1
    toxic = np.array([row["toxic"] for row in rows], np.float64)
    weights, bias = fit_weights(present, toxic, swap_rows(present, terms, settings.identity), ridge, settings)
    return Model({t: float(v) for t, v in zip(terms, weights) if abs(v) > 1e-9}, bias)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` (0 to 1) of every whole text and ``predicted``; a null or empty text scores the bias alone."""
    ready(docs.sparkSession)
    make = lambda: lambda texts: {"score": [model.score(t) for t in texts]}
    scored = map_texts(docs, {"score": "double"}, make, id_col, text_col)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, in all columns, that score below one half."""
    ready(docs.sparkSession)
    return keep_rows(docs, lambda: lambda texts: [model.score(t) < 0.5 for t in texts], text_col)
