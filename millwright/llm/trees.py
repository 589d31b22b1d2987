"""Gradient-boosted decision trees for two classes, on binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth, each a complete binary tree in arrays, fitted to the gradient of the logistic loss."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.base = 0.0
        self.features: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-9)
                split = np.full(width, -1)
                for j, e in enumerate(edges):
                    cell = (node - first) * (len(e) + 1) + binned[:, j]
                    g = np.bincount(cell, grad, width * (len(e) + 1)).reshape(width, -1).cumsum(axis=1)
                    h = np.bincount(cell, hess, width * (len(e) + 1)).reshape(width, -1).cumsum(axis=1)
                    if len(e) == 0:
                        continue
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(width), at] > best
                    for k in np.flatnonzero(better):
                        best[k], split[k] = gain[k, at[k]], at[k]
                        feature[first + k], cut[first + k] = j, e[at[k]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + self.ridge)
            margin += value[leaf]
            self.features.append(feature)
            self.cuts.append(cut)
            self.leaves.append(value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out
