"""Small gradient-boosted trees on binned features, and isotonic calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic gradient boosting with complete trees of fixed depth over quantile bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, leaf: float = 20.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf, self.ridge = trees, depth, rate, bins, leaf, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        b = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)
        mean = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            features, limits = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                for j in range(d):
                    m = len(self.edges[j]) + 1
                    if m < 2:
                        continue
                    cell = (node - first) * m + b[:, j]
                    gs = np.cumsum(np.bincount(cell, weights=g, minlength=width * m).reshape(width, m), axis=1)
                    hs = np.cumsum(np.bincount(cell, weights=h, minlength=width * m).reshape(width, m), axis=1)
                    ns = np.cumsum(np.bincount(cell, minlength=width * m).reshape(width, m), axis=1)
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(ns < self.leaf) | (nt - ns < self.leaf)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    better = top > best + 1e-12
                    best[better] = top[better]
                    features[first : first + width][better] = j
                    limits[first : first + width][better] = k[better]
                node = 2 * node + 1 + (b[np.arange(n), features[node]] > limits[node])
            leaf = node - (2**self.depth - 1)
            gl, hl = np.bincount(leaf, weights=g, minlength=2**self.depth), np.bincount(leaf, weights=h, minlength=2**self.depth)
            value = self.rate * gl / (hl + self.ridge)
            f += value[leaf]
            self.splits.append((features, limits, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)
        rows, f = np.arange(len(x)), np.full(len(x), self.base)
        for features, limits, value in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, features[node]] > limits[node])
            f += value[node - (2**self.depth - 1)]
        return f


class Isotonic:
    """Non-decreasing step fit of labels on margins (pool adjacent violators), linear in between."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, weight, sum of margins
        for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([v, 1.0, m])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                a = blocks.pop()
                for i in range(3):
                    blocks[-1][i] += a[i]
        self.at = np.array([b[2] / b[1] for b in blocks])
        # scores stay off 0 and 1 by half a row
        off = 0.5 / (len(margin) + 1)
        self.value = np.clip(np.array([b[0] / b[1] for b in blocks]), off, 1 - off)
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)
