"""Gradient-boosted regression trees for a two-class label, by histograms."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of one fixed depth; each holds its splits level by level, so many rows are scored at once."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
        # Features of two values are summed by one product for all of them, the others by histograms.
        pairs = [f for f, e in enumerate(edges) if len(e) == 1]
        low = (binned[pairs] == 0).astype(np.float32)
        rate = y.mean()
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        nodes = 2**self.depth
        self.feature = np.zeros((self.trees, nodes), np.int64)
        self.cut = np.full((self.trees, nodes), np.inf)
        self.leaf = np.zeros((self.trees, nodes))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            at = np.ones(len(y), np.int64)
            for level in range(self.depth):
                width = 2**level
                local = at - width
                best = np.full(width, 1e-6)
                choice = np.full((width, 2), -1)
                total_g, total_h = np.bincount(local, g, width), np.bincount(local, h, width)
                by_node = np.zeros((len(y), 2 * width), np.float32)
                by_node[np.arange(len(y)), local], by_node[np.arange(len(y)), width + local] = g, h
                lows = low @ by_node
                for f in range(x.shape[1]):
                    k = len(edges[f]) + 1
                    if k == 2:
                        row = lows[pairs.index(f)].astype(float)
                        left_g, left_h = row[:width, None], row[width:, None]
                    elif k > 2:
                        key = local * k + binned[f]
                        left_g = np.bincount(key, g, width * k).reshape(width, k).cumsum(1)[:, :-1]
                        left_h = np.bincount(key, h, width * k).reshape(width, k).cumsum(1)[:, :-1]
                    else:
                        continue
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (total_g**2 / (total_h + 1))[:, None]
                    gain[(left_h < self.least / 20) | (right_h < self.least / 20)] = 0
                    i = gain.argmax(1)
                    top = gain[np.arange(width), i]
                    choice[top > best] = np.stack([np.full(width, f), i], 1)[top > best]
                    best = np.maximum(best, top)
                for n in range(width):
                    f, i = choice[n]
                    if f >= 0:
                        self.feature[t, width + n], self.cut[t, width + n] = f, edges[f][i]
                at = 2 * at + (x[np.arange(len(y)), self.feature[t, at]] > self.cut[t, at])
            local = at - nodes
            self.leaf[t] = self.rate * np.bincount(local, g, nodes) / (np.bincount(local, h, nodes) + 1)
            score += self.leaf[t][local]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + (x[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t][at - 2**self.depth]
        return out
