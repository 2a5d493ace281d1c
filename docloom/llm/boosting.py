"""Small gradient-boosted trees for binary labels, for training sets that fit in one task."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Newton-boosted trees of fixed depth on log-loss, with splits at observed quantiles."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, smooth: float = 1.0, bins: int = 24):
        self.rounds, self.depth, self.rate, self.smooth, self.bins = rounds, depth, rate, smooth, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _best_split(self, x, g, h, edges):
        best = (0.0, 0, np.inf)
        total_g, total_h = g.sum(), h.sum()
        whole = total_g**2 / (total_h + self.smooth)
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            where = np.searchsorted(cuts, x[:, f], side="left")
            left_g = np.cumsum(np.bincount(where, g, len(cuts) + 1))[:-1]
            left_h = np.cumsum(np.bincount(where, h, len(cuts) + 1))[:-1]
            gain = left_g**2 / (left_h + self.smooth) + (total_g - left_g) ** 2 / (total_h - left_h + self.smooth) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, float(cuts[k]))
        return best[1], best[2]

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[:-1])) for f in range(x.shape[1])]
        score = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for k in range(inner):
                here = node == k
                if here.sum() >= 2:
                    feature[k], cut[k] = self._best_split(x[here], g[here], h[here], edges)
                node[here] = 2 * k + 1 + (x[here, feature[k]] > cut[k])
            leaf = node - inner
            size = 2**self.depth
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.smooth)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += value[node - len(cut)]
        return 1 / (1 + np.exp(-score))
