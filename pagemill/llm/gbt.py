"""Small gradient-boosted trees (softmax loss, histogram splits) in numpy, for models fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Multi-class boosted regression trees of fixed depth. Fitting is deterministic."""

    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int) -> "BoostedTrees":
        n, f = x.shape
        self.classes = classes
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], side="right") for j in range(f)], axis=1)
        onehot = np.eye(classes)[y]
        prior = onehot.mean(axis=0)
        self.base = np.log(np.maximum(prior, 1e-3))
        score = np.tile(self.base, (n, 1))
        self.trees: list[list[tuple]] = []
        for _ in range(self.rounds):
            p = _softmax(score)
            row = []
            for k in range(classes):
                tree = self._tree(b, p[:, k] - onehot[:, k], p[:, k] * (1 - p[:, k]))
                score[:, k] += self._walk(tree, b)
                row.append(tree)
            self.trees.append(row)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> dict:
        n, f = b.shape
        feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, self.bins + 1)
        node = np.zeros(n, int)
        width = self.bins + 1
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            gain_best = np.full(count, 1e-6)
            for j in range(f):
                at = (node - first) * width + b[:, j]
                gs = np.bincount(at, g, count * width).reshape(count, width)
                hs = np.bincount(at, h, count * width).reshape(count, width)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                best = gain[:, :-1].argmax(1)
                value = gain[np.arange(count), best]
                better = value > gain_best
                gain_best = np.where(better, value, gain_best)
                feature[first : first + count][better] = j
                cut[first : first + count][better] = best[better]
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = node - (2**self.depth - 1)
        gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
        return {"feature": feature, "cut": cut, "leaf": -self.rate * gs / (hs + self.l2)}

    def _walk(self, tree: dict, b: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), int)
        rows = np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, tree["feature"][node]] > tree["cut"][node])
        return tree["leaf"][node - (2**self.depth - 1)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)
        out = np.tile(self.base, (len(x), 1))
        for row in self.trees:
            for k, tree in enumerate(row):
                out[:, k] += self._walk(tree, b)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """Choose the temperature with the least log loss on a holdout."""
        s = self.scores(x)
        grid = np.geomspace(0.25, 8, 41)
        loss = [-np.log(np.maximum(_softmax(s / t)[np.arange(len(y)), y], 1e-9)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated class probabilities."""
        return _softmax(self.scores(x) / self.temperature)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
