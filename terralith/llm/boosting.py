"""Gradient-boosted trees for two classes: logistic loss, binned features, trees of one depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """feature, threshold: by tree and inner node, level after level; leaves: by tree and leaf; base: log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    leaves: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaves.shape[1]))
        for feature, threshold, leaves in zip(self.feature, self.threshold, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaves[node - len(feature)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0) -> Trees:
        y = y.astype(float)
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T, strict=True)])
        base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
        odds = np.full(len(y), base)
        inner = (1 << depth) - 1
        out = cls(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-odds))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                local = node - first
                best = np.full(width, 1e-9)
                total_g, total_h = np.bincount(local, g, width), np.bincount(local, h, width)
                whole = total_g**2 / (total_h + ridge)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    size = len(c) + 1
                    where = local * size + binned[f]
                    left_g = np.bincount(where, g, width * size).reshape(width, size).cumsum(axis=1)[:, :-1]
                    left_h = np.bincount(where, h, width * size).reshape(width, size).cumsum(axis=1)[:, :-1]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - whole[:, None]
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    for k in np.flatnonzero(top > best):
                        best[k] = top[k]
                        out.feature[t, first + k], out.threshold[t, first + k] = f, c[at[k]]
                node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.threshold[t, node])
            leaf = node - inner
            out.leaves[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
            odds += out.leaves[t, leaf]
        return out
