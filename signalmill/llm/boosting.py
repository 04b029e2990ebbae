"""Gradient-boosted trees with a logistic loss, and a calibration of their scores."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Regression trees of bounded depth on histogram cuts, fitted to the
    gradient of the logistic loss by Newton steps."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 1.0, cuts: int = 32):
        self.rounds, self.depth, self.rate, self.least, self.cuts = rounds, depth, rate, least, cuts
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.cuts + 1)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, edges, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(tree, x)
        return self

    def _grow(self, bins, edges, gradient, weight):
        """A complete tree as arrays: feature (-1: none), cut, value by node."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(gradient), int)
        width = max(map(len, edges)) + 1
        offset = np.arange(len(edges)) * width
        cuttable = np.arange(width) < np.array([len(e) for e in edges])[:, None]
        for k in range(size):
            here = np.flatnonzero(node == k)
            if not len(here):
                continue
            g, h = gradient[here].sum(), weight[here].sum()
            value[k] = -self.rate * g / (h + self.least)
            if k >= size // 2:
                continue
            # one histogram for all features, a row of equal width for each
            at = (bins[here] + offset).ravel()
            left_g = np.bincount(at, np.repeat(gradient[here], len(edges)), offset[-1] + width).reshape(-1, width).cumsum(1)
            left_h = np.bincount(at, np.repeat(weight[here], len(edges)), offset[-1] + width).reshape(-1, width).cumsum(1)
            gain = left_g**2 / (left_h + self.least) + (g - left_g) ** 2 / (h - left_h + self.least) - g**2 / (h + self.least)
            gain[~cuttable] = 0
            f, c = divmod(int(gain.argmax()), width)
            if gain[f, c] > 1e-6:
                feature[k], cut[k] = f, edges[f][c]
            if feature[k] >= 0:
                right = bins[here, feature[k]] > np.searchsorted(edges[feature[k]], cut[k], "left")
                node[here] = 2 * k + 1 + right
        return feature, cut, value

    @staticmethod
    def _walk(tree, x):
        feature, cut, value = tree
        node = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                return value[node]
            at = node[inner]
            node[inner] = 2 * at + 1 + (x[inner, feature[at]] > cut[at])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))


class Calibration:
    """Scores to probabilities by isotonic regression (pool adjacent violators)."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Calibration:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, highest score
        for s, v in zip(score[order], y[order], strict=True):
            blocks.append([float(v), 1.0, float(s)])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                v2, w2, s2 = blocks.pop()
                v1, w1, _ = blocks.pop()
                blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, s2])
        self.top = np.array([b[2] for b in blocks])
        self.mean = np.array([b[0] for b in blocks])
        return self

    def probability(self, score: np.ndarray) -> np.ndarray:
        return self.mean[np.minimum(np.searchsorted(self.top, score, "left"), len(self.mean) - 1)]
