"""Gradient-boosted trees for a yes/no label: binned features, logistic loss, a few levels deep."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees as arrays: node k splits `feature[k]` at bin > `cut[k]` into nodes 2k+1 (no) and 2k+2 (yes)."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, pull: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.pull = rounds, depth, rate, bins, pull
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        b, f = self._binned(x), np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            f += self._grow(b, y - p, p * (1 - p))
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node, width = np.zeros(len(g), np.int64), self.bins
        for k in range(size):
            here = np.flatnonzero(node == k)
            if not len(here):
                continue
            sg, sh = g[here].sum(), h[here].sum()
            value[k] = self.rate * sg / (sh + self.pull)
            if k >= 2**self.depth - 1:
                continue
            best = 1e-6
            for j in range(b.shape[1]):
                lg = np.cumsum(np.bincount(b[here, j], g[here], width))[:-1]
                lh = np.cumsum(np.bincount(b[here, j], h[here], width))[:-1]
                gain = lg**2 / (lh + self.pull) + (sg - lg) ** 2 / (sh - lh + self.pull) - sg**2 / (sh + self.pull)
                if gain.max() > best:
                    best, feature[k], cut[k] = gain.max(), j, gain.argmax()
            if feature[k] >= 0:
                node[here] = 2 * k + 1 + (b[here, feature[k]] > cut[k])
        self.trees.append((feature, cut, value))
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        f, b = np.full(len(x), self.start), self._binned(x)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                split = feature[node] >= 0
                right = b[np.arange(len(x)), np.maximum(feature[node], 0)] > cut[node]
                node = np.where(split, 2 * node + 1 + right, node)
            f += value[node]
        return 1 / (1 + np.exp(-f))
