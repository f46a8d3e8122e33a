"""Gradient-boosted regression trees, trained on a bounded sample in one process and applied to arrays."""

from __future__ import annotations

import numpy as np


class Tree:
    """A regression tree of fixed depth as arrays: node k has the children 2 k + 1 and 2 k + 2."""

    def __init__(self, depth: int):
        n = 2**depth - 1
        self.depth, self.feature, self.cut, self.value = depth, np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.zeros(2**depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.cut[at])
        return at - (2**self.depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


def _split(x: np.ndarray, bins: list[np.ndarray], codes: np.ndarray, g: np.ndarray, least: int) -> tuple[int, float]:
    """Feature and cut of the greatest gain in squared error; a cut of infinity if no split leaves `least` rows on both sides."""
    best, found = 1e-12, (0, np.inf)
    total, n = g.sum(), len(g)
    for f in range(x.shape[1]):
        k = len(bins[f]) + 1
        if k < 2:
            continue
        count, sums = np.bincount(codes[:, f], minlength=k)[:-1].cumsum(), np.bincount(codes[:, f], weights=g, minlength=k)[:-1].cumsum()
        ok = (count >= least) & (n - count >= least)
        if not ok.any():
            continue
        gain = np.where(ok, sums**2 / np.maximum(count, 1) + (total - sums) ** 2 / np.maximum(n - count, 1) - total**2 / n, -1)
        if gain.max() > best:
            best, found = gain.max(), (f, float(bins[f][gain.argmax()]))
    return found


class Boosted:
    """Squared-error boosting with shrinkage and row sampling; cuts are quantiles of the training values."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.1, sample: float = 0.7, least: int = 20, cuts: int = 32, seed: int = 8):
        self.n, self.depth, self.rate, self.sample, self.least, self.cuts, self.seed = trees, depth, rate, sample, least, cuts, seed
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        r = np.random.default_rng(self.seed)
        bins = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.cuts + 2)[1:-1])) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bins)], axis=1)
        self.base = float(y.mean())
        now = np.full(len(y), self.base)
        for _ in range(self.n):
            own = np.flatnonzero(r.random(len(y)) < self.sample)
            left = y - now
            tree = Tree(self.depth)
            rows = {0: own}
            for k in range(2**self.depth - 1):
                mine = rows[k]
                if len(mine) >= 2 * self.least:
                    tree.feature[k], tree.cut[k] = _split(x[mine], bins, codes[mine], left[mine], self.least)
                over = x[mine, tree.feature[k]] > tree.cut[k]
                rows[2 * k + 1], rows[2 * k + 2] = mine[~over], mine[over]
            first = 2**self.depth - 1
            for k in range(first, 2 * first + 1):
                if len(rows[k]):
                    tree.value[k - first] = self.rate * left[rows[k]].mean()
            self.trees.append(tree)
            now += tree.predict(x)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.predict(x)
        return out
