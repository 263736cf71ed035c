"""Gradient-boosted trees for binary targets, in numpy: histogram splits, Newton leaf values."""

from __future__ import annotations

import numpy as np

BINS = 24


class BoostedTrees:
    """Additive log-odds of depth-limited trees; ``fit`` on features (rows, columns) and 0/1 targets."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, leaf_weight: float = 2.0):
        self.trees, self.depth, self.rate, self.leaf_weight = trees, depth, rate, leaf_weight
        self.base = 0.0
        self.edges: list[np.ndarray] = []
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        p = min(0.999, max(0.001, y.mean()))
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            feature, cut = np.zeros(inner, np.int32), np.full(inner, BINS + 1, np.int32)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for node in range(first, 2 * first + 1):
                    rows = np.flatnonzero(at == node)
                    if len(rows) >= 4:
                        feature[node], cut[node] = self._split(b[rows], g[rows], h[rows])
                at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] >= cut[at])
            leaf = at - inner
            gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            value = self.rate * gs / (hs + self.leaf_weight)
            score += value[leaf]
            self.forest.append((feature, cut, value))
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best, where = 1e-6, (0, BINS + 1)
        total_g, total_h = g.sum(), h.sum()
        whole = total_g**2 / (total_h + self.leaf_weight)
        for j in range(b.shape[1]):
            gl, hl = np.cumsum(np.bincount(b[:, j], g, BINS + 1))[:-1], np.cumsum(np.bincount(b[:, j], h, BINS + 1))[:-1]
            gain = gl**2 / (hl + self.leaf_weight) + (total_g - gl) ** 2 / (total_h - hl + self.leaf_weight) - whole
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, where = gain[k], (j, k + 1)
        return where

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._binned(np.asarray(x, dtype=np.float64))
        score = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for feature, cut, value in self.forest:
            at = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] >= cut[at])
            score += value[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))
