"""Gradient-boosted trees on binned features, with isotonic calibration. For tables that fit in the driver."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting; each tree is a full binary tree of the given depth."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 32, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.penalty = trees, depth, rate, bins, penalty

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = self.binned(x)
        p = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.start)
        self.forest = []
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-raw))
            tree = self.grow(b, weight * (q - y), weight * q * (1 - q))
            self.forest.append(tree)
            raw += self.walk(tree, b)
        return self

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins + 1)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, many = (1 << level) - 1, 1 << level
            best = np.zeros(many)
            at = node - first
            for f in range(b.shape[1]):
                key = at * (self.bins + 1) + b[:, f]
                size = many * (self.bins + 1)
                gs = np.cumsum(np.bincount(key, g, size).reshape(many, -1), 1)
                hs = np.cumsum(np.bincount(key, h, size).reshape(many, -1), 1)
                score = lambda a, c: a * a / (c + self.penalty)
                gain = score(gs, hs) + score(gs[:, -1:] - gs, hs[:, -1:] - hs) - score(gs[:, -1:], hs[:, -1:])
                gain[(hs < 1e-3) | (hs[:, -1:] - hs < 1e-3)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(many), top]
                better = value > best + 1e-9
                best[better] = value[better]
                feature[first : first + many][better] = f
                cut[first : first + many][better] = top[better]
            node = node * 2 + 1 + (b[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        leaves = 1 << self.depth
        return feature, cut, -self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + self.penalty)

    def walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            node = node * 2 + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.start + sum((self.walk(t, b) for t in self.forest), np.zeros(len(x)))


class Isotonic:
    """The non-decreasing step function that is nearest to weighted labels, by pooling neighbours; linear between steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, least x, greatest x
        for v, t, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
            blocks.append([t, w, v, v])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, n, _, hi = blocks.pop()
                last = blocks[-1]
                last[0] = (last[0] * last[1] + m * n) / (last[1] + n)
                last[1] += n
                last[3] = hi
        self.x = np.array([z for k in blocks for z in (k[2], k[3])])
        self.y = np.array([z for k in blocks for z in (k[0], k[0])])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)
