"""A small gradient-boosted tree classifier in NumPy, for models trained here on bounded samples."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, trees of a fixed depth over binned features. Training is deterministic; missing values are not allowed."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        # half of the bins by rank, half by value: where most rows share a value, the rest still gets its cuts
        half = self.bins // 2
        edges = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, half + 1)[1:-1]), np.linspace(c.min(), c.max(), half + 2)[1:-1]])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        margin = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p) + 1e-6
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for n in range(inner):
                at = np.flatnonzero(node == n)
                gain, best = 1e-9, None
                if len(at) > 1:
                    gs, hs = g[at].sum(), h[at].sum()
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[at, f]
                        gl = np.cumsum(np.bincount(b, g[at], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[at], len(e) + 1))[:-1]
                        value = gl**2 / (hl + self.least) + (gs - gl) ** 2 / (hs - hl + self.least) - gs**2 / (hs + self.least)
                        if value[k := int(value.argmax())] > gain:
                            gain, best = value[k], (f, e[k])
                if best:
                    feature[n], cut[n] = best
                node[at] = 2 * n + 1 + (x[at, feature[n]] > cut[n])
            leaf = node - inner
            gsum, hsum = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            value = -self.rate * gsum / (hsum + self.least)
            self.trees.append((feature, cut, value))
            margin += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Chance of the positive class for each row."""
        x = np.asarray(x, float)
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += value[node - len(feature)]
        return 1 / (1 + np.exp(-margin))
