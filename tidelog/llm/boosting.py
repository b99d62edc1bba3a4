"""Gradient-boosted trees for small tables of numbers: logistic loss, exact splits on quantile bins, Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Complete binary tree in breadth-first order; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return self.value[at]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, bins: list[np.ndarray], ridge: float, rate: float) -> Tree:
    size = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    rows = {0: np.arange(len(x))}
    for node in range(size):
        if node not in rows:
            continue
        r = rows[node]
        gs, hs = g[r].sum(), h[r].sum()
        value[node] = -rate * gs / (hs + ridge)
        if 2 * node + 2 >= size or len(r) < 10:
            continue
        best = (1e-6, -1, 0.0)
        for f, edges in enumerate(bins):
            if not len(edges):
                continue
            b = np.searchsorted(edges, x[r, f])
            gl = np.cumsum(np.bincount(b, g[r], len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[r], len(edges) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, edges[k])
        if best[1] >= 0:
            feature[node], threshold[node] = best[1], best[2]
            right = x[r, best[1]] > best[2]
            if right.all() or not right.any():
                feature[node] = -1
                continue
            rows[2 * node + 1], rows[2 * node + 2] = r[~right], r[right]
    return Tree(feature, threshold, value)


@dataclass
class Model:
    trees: list[Tree]
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, most_bins: int = 32) -> Model:
    """Boosted trees on the even rows; the odd rows calibrate."""
    xt, yt, xc, yc = x[::2], y[::2], x[1::2], y[1::2]
    bins = [np.unique(np.quantile(xt[:, f], np.linspace(0, 1, most_bins + 1)[1:-1])) for f in range(x.shape[1])]
    bins = [b[b < xt[:, f].max()] for f, b in enumerate(bins)]
    p = np.clip(yt.mean(), 1e-3, 1 - 1e-3)
    model = Model([], float(np.log(p / (1 - p))))
    score = np.full(len(xt), model.bias)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        tree = _grow(xt, q - yt, np.maximum(q * (1 - q), 1e-9), depth, bins, ridge, rate)
        model.trees.append(tree)
        score = score + tree.predict(xt)
    raw = model.raw(xc)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a regularised logistic regression on the raw score
        q = 1 / (1 + np.exp(-np.clip(a * raw + b, -60, 60)))
        w = np.maximum(q * (1 - q), 1e-9)
        grad = np.array([((q - yc) * raw).sum() + 1e-2 * (a - 1), (q - yc).sum() + 1e-2 * b])
        hess = np.array([[(w * raw * raw).sum() + 1e-2, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-2]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    model.slope, model.shift = float(a), float(b)
    return model


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Smallest threshold at which the held-out precision reaches what is asked for; above 1 if none does."""
    order = np.argsort(-p)
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ok = np.flatnonzero(good >= precision)
    return float(p[order][ok[-1]]) if len(ok) else 1.1
