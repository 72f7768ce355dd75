"""Gradient-boosted trees for a yes-or-no label, on histograms of binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, cuts: list[np.ndarray], trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], base: float, depth: int):
        self.cuts, self.trees, self.base, self.depth = cuts, trees, base, depth

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, smooth: float = 1.0) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        model = cls(cuts, [], float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1))), depth)
        b = model._binned(x).astype(np.int64)
        f = np.full(len(y), model.base)
        offsets = np.arange(x.shape[1]) * bins
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.int64)
            for level in range(depth):
                for k in range(2**level):
                    rows = np.flatnonzero(node == k)
                    at = 2**level - 1 + k
                    if len(rows) < 8:
                        continue
                    flat = (b[rows] + offsets).ravel()
                    size = x.shape[1] * bins
                    gs = np.bincount(flat, np.repeat(g[rows], x.shape[1]), size).reshape(-1, bins).cumsum(axis=1)
                    hs = np.bincount(flat, np.repeat(h[rows], x.shape[1]), size).reshape(-1, bins).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
                    gain[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                    j, c = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[j, c] > 1e-9:
                        feature[at], cut[at] = j, c
                at = 2**level - 1 + node
                node = 2 * node + (b[np.arange(len(b)), feature[at]] > cut[at])
            gl, hl = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            leaf = rate * gl / (hl + smooth)
            model.trees.append((feature, cut, leaf))
            f += leaf[node]
        return model

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (b[rows, feature[at]] > cut[at])
            f += leaf[node]
        return f
