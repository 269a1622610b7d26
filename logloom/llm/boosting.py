"""Gradient-boosted trees for two classes, over binned features."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete binary trees as arrays; ``score`` gives the log odds of the first class of each row."""

    def __init__(self, feature: np.ndarray, limit: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.limit, self.leaf, self.base = feature, limit, leaf, base

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            at = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (rows[every, feature[at]] > limit[at])
            total += leaf[at - (len(leaf) - 1)]
        return total


def fit(rows: np.ndarray, wanted: np.ndarray, weights: np.ndarray, rounds: int = 100, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 5.0) -> Trees:
    """Boost ``rounds`` trees on the logistic loss, each over half of the features; the same rows give the same trees."""
    n, all_width = rows.shape
    width = (all_width + 1) // 2
    rng = np.random.default_rng(0)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(all_width)]
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1)
    share = np.average(wanted, weights=weights)
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    inner = 2**depth - 1
    features, limits, leaves = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-total))
        slope, curve = weights * (wanted - p), weights * p * (1 - p)
        at = np.zeros(n, np.int64)
        chosen = np.sort(rng.permutation(all_width)[:width])
        flat = binned[:, chosen] + np.arange(width) * bins
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            cut, best = None, 1e-9
            if len(mine) > 1:
                index = flat[mine].ravel()
                g = np.bincount(index, np.repeat(slope[mine], width), width * bins).reshape(width, bins).cumsum(axis=1)
                c = np.bincount(index, np.repeat(curve[mine], width), width * bins).reshape(width, bins).cumsum(axis=1)
                g_all, c_all = g[0, -1], c[0, -1]
                gain = g**2 / (c + ridge) + (g_all - g) ** 2 / (c_all - c + ridge) - g_all**2 / (c_all + ridge)
                f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[f, b] > best and b < len(edges[chosen[f]]):
                    cut = (chosen[f], b)
            if cut is None:
                at[mine] = 2 * node + 1
                continue
            features[t, node], limits[t, node] = cut[0], edges[cut[0]][cut[1]]
            at[mine] = 2 * node + 1 + (binned[mine, cut[0]] > cut[1])
        at -= inner
        g, c = np.bincount(at, slope, inner + 1), np.bincount(at, curve, inner + 1)
        leaves[t] = rate * g / (c + ridge)
        total += leaves[t][at]
    return Trees(features, limits, leaves, base)
