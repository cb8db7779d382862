"""Gradient-boosted regression trees for two classes, on binned features."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees of one fixed depth, kept as arrays: inner nodes first, then leaves."""

    def __init__(self, depth: int = 4, trees: int = 60, rate: float = 0.2, leaf_weight: float = 5.0):
        self.depth, self.trees, self.rate, self.leaf_weight = depth, trees, rate, leaf_weight
        self.start = 0.0
        self.cuts: list[np.ndarray] = []
        self.feature = np.zeros((0, 0), np.int64)
        self.bound = np.zeros((0, 0), np.float64)
        self.value = np.zeros((0, 0), np.float64)

    def fit(self, rows: np.ndarray, target: np.ndarray) -> BoostedTrees:
        """``target`` lies between 0 and 1 and may be soft."""
        n, width = rows.shape
        self.cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)
        inner = 2**self.depth - 1
        mean = float(np.clip(target.mean(), 0.01, 0.99))
        self.start = float(np.log(mean / (1 - mean)))
        total = np.full(n, self.start)
        features, bounds, values = [], [], []
        column = np.arange(width) * BINS
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-total))
            slope, curve = target - p, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(n, np.int64)
            feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                cell = ((at - first)[:, None] * (width * BINS) + column + binned).ravel()
                shape = (count, width, BINS)
                g = np.bincount(cell, np.repeat(slope, width), count * width * BINS).reshape(shape).cumsum(axis=2)
                h = np.bincount(cell, np.repeat(curve, width), count * width * BINS).reshape(shape).cumsum(axis=2)
                all_g, all_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                gain[(h < self.leaf_weight) | (all_h - h < self.leaf_weight)] = -1
                flat = gain.reshape(count, -1)
                best = flat.argmax(axis=1)
                good = flat[np.arange(count), best] > 1e-9
                f, b = best // BINS, best % BINS
                for i in np.flatnonzero(good):
                    if b[i] < len(self.cuts[f[i]]):
                        feature[first + i], bound[first + i] = f[i], self.cuts[f[i]][b[i]]
                right = rows[np.arange(n), feature[at]] > bound[at]
                at = 2 * at + 1 + right
            leaf = at - inner
            top = np.bincount(leaf, slope, inner + 1)
            value = self.rate * top / (np.bincount(leaf, curve, inner + 1) + 1)
            total += value[leaf]
            features.append(feature), bounds.append(bound), values.append(value)
        self.feature, self.bound, self.value = np.array(features), np.array(bounds), np.array(values)
        return self

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        total = np.full(len(rows), self.start)
        index = np.arange(len(rows))
        inner = 2**self.depth - 1
        for feature, bound, value in zip(self.feature, self.bound, self.value):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (rows[index, feature[at]] > bound[at])
            total += value[at - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))
