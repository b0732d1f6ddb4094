"""Gradient-boosted trees in numpy: full binary trees of one depth over binned features, softmax over classes."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """``fit`` on a bounded sample, ``log_proba`` anywhere; ties of splits go to the first feature and bin."""

    def __init__(self, edges: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, value: np.ndarray, start: np.ndarray):
        self.edges, self.feature, self.cut, self.value, self.start = edges, feature, cut, value, start

    @staticmethod
    def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1).astype(np.uint8)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: int, *, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 2.0, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = cls._binned(x, edges)
        n, f = b.shape
        places = b.astype(np.int64) + np.arange(f) * bins  # of a row's features in a histogram
        share = np.array([weight[y == c].sum() for c in range(classes)]) + 1.0
        start = np.log(share / share.sum())
        score = np.tile(start, (n, 1))
        features, cuts, values = [], [], []
        for _ in range(rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for c in range(classes):
                g, h = weight * (p[:, c] - (y == c)), weight * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                node = np.zeros(n, np.int64)
                feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins, np.int64)
                for level in range(depth):
                    at = (places + (node * f * bins)[:, None]).ravel()
                    size = 2**level * f * bins
                    left_g, left_h = (np.bincount(at, np.repeat(v, f), size).reshape(-1, f, bins).cumsum(2) for v in (g, h))
                    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
                    gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
                    gain[(left_h < 1.0) | (all_h - left_h < 1.0)] = 0
                    best = gain.reshape(len(gain), -1).argmax(1)
                    use = gain.reshape(len(gain), -1)[np.arange(len(gain)), best] > 1e-9
                    first = 2**level - 1
                    feature[first : first + 2**level] = np.where(use, best // bins, 0)
                    cut[first : first + 2**level] = np.where(use, best % bins, bins)
                    mine = first + node
                    node = 2 * node + (b[np.arange(n), feature[mine]] > cut[mine])
                sums_g, sums_h = (np.bincount(node, v, 2**depth) for v in (g, h))
                value = -rate * sums_g / (sums_h + l2)
                score[:, c] += value[node]
                features.append(feature), cuts.append(cut), values.append(value)
        return cls(edges, np.array(features), np.array(cuts), np.array(values).reshape(rounds, classes, -1), start)

    def log_proba(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x, self.edges), np.arange(len(x))
        rounds, classes, leaves = self.value.shape
        score = np.tile(self.start, (len(x), 1))
        for t in range(rounds * classes):
            node = np.zeros(len(x), np.int64)
            first = 0
            for _ in range(leaves.bit_length() - 1):
                mine = first + node
                node = 2 * node + (b[rows, self.feature[t, mine]] > self.cut[t, mine])
                first = 2 * first + 1
            score[:, t % classes] += self.value[t // classes, t % classes, node]
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))
