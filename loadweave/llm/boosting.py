"""Gradient-boosted trees on binned features, and isotonic calibration (numpy, driver side)."""

from __future__ import annotations

import numpy as np


def bin_edges(x: np.ndarray, bins: int = 64) -> list[np.ndarray]:
    """Distinct quantiles of each feature."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)


class Boosted:
    """Logistic boosting with Newton leaves; trees are complete, of a fixed depth."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 5.0, bins: int = 64):
        self.rounds, self.depth, self.rate, self.ridge, self.bins = rounds, depth, rate, ridge, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = bin_edges(x, self.bins)
        held = binned(x, self.edges)
        mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            chance = 1 / (1 + np.exp(-score))
            tree, leaf = self._tree(held, chance - y, chance * (1 - chance))
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _tree(self, held, gradient, weight):
        nodes = (1 << self.depth) - 1
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, 255, np.int64)
        at = np.zeros(len(held), np.int64)
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-6)
            for f in range(held.shape[1]):
                cell = at * 256 + held[:, f]
                g = np.bincount(cell, gradient, count * 256).reshape(count, 256).cumsum(axis=1)
                h = np.bincount(cell, weight, count * 256).reshape(count, 256).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge) - all_g**2 / (all_h + self.ridge)
                gain[(h < 1.0) | (all_h - h < 1.0)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(count), top]
                better = value > best
                best = np.where(better, value, best)
                feature[first : first + count] = np.where(better, f, feature[first : first + count])
                cut[first : first + count] = np.where(better, top, cut[first : first + count])
            node = first + at
            at = at * 2 + (held[np.arange(len(held)), feature[node]] > cut[node])
        leaves = 1 << self.depth
        g, h = np.bincount(at, gradient, leaves), np.bincount(at, weight, leaves)
        return (feature, cut, -self.rate * g / (h + self.ridge)), at

    def score(self, x: np.ndarray) -> np.ndarray:
        held = binned(x, self.edges)
        rows = np.arange(len(held))
        total = np.full(len(held), self.start)
        for feature, cut, value in self.trees:
            at = np.zeros(len(held), np.int64)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                at = at * 2 + (held[rows, feature[node]] > cut[node])
            total += value[at]
        return total


class Isotonic:
    """Monotone step calibration by pooling adjacent violators; linear between block centres."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []
        for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([v, 1.0, s])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                v2, n2, s2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2] + s2]
        self.x = np.array([s / n for _, n, s in blocks])
        self.y = np.array([v / n for v, n, _ in blocks])
        return self

    def apply(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0.0, 1.0) if len(self.x) else np.full(len(score), 0.5)
