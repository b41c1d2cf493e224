"""Gradient-boosted trees for a yes/no label: histogram splits, logistic loss, numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth: per tree and inner node a feature and a threshold, per leaf a value."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while True:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
                if at[0] >= len(f):  # all rows are equally deep
                    break
            out += leaf[at - len(f)]
        return out if len(x) else np.zeros(0)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 5, rate: float = 0.25, bins: int = 32, penalty: float = 1.0) -> Boosted:
    """Fits on all rows; deterministic."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    width = bins + 1
    inner = 2**depth - 1
    p = y.mean().clip(1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    score = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    flat = binned + np.arange(x.shape[1]) * width
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = y - prob, prob * (1 - prob) + 1e-9
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            if len(mine) >= 8:
                cells = flat[mine].ravel()
                size = x.shape[1] * width
                g = np.bincount(cells, np.repeat(grad[mine], x.shape[1]), size).reshape(-1, width).cumsum(1)
                h = np.bincount(cells, np.repeat(hess[mine], x.shape[1]), size).reshape(-1, width).cumsum(1)
                total_g, total_h = g[0, -1], h[0, -1]
                gain = g**2 / (h + penalty) + (total_g - g)**2 / (total_h - h + penalty) - total_g**2 / (total_h + penalty)
                gain[(h < 1) | (total_h - h < 1)] = 0
                for f, c in enumerate(cuts):
                    gain[f, len(c):] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    feature[node], threshold[node] = best // width, cuts[best // width][best % width]
            here = x[mine, feature[node]] > threshold[node]
            at[mine] = 2 * node + 1 + here
        slot = at - inner
        value = rate * np.bincount(slot, grad, inner + 1) / (np.bincount(slot, hess, inner + 1) + penalty)
        score += value[slot]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Boosted(np.array(features), np.array(thresholds), np.array(leaves), base)
