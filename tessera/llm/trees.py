"""Regression trees over binned features, boosted for the logistic loss; isotonic regression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """Rows with feature <= at go left."""

    feature: int
    at: float
    left: Leaf | Split
    right: Leaf | Split


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def bin_edges(x: np.ndarray, bins: int = 64) -> list[np.ndarray]:
    """Candidate cuts of each feature, between neighbouring values at its quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        out.append(middle if len(middle) < bins else np.unique(middle[np.searchsorted(values[1:], np.quantile(column, np.arange(1, bins) / bins)).clip(0, len(middle) - 1)]))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1) if len(edges) else x.astype(int)


def grow(b: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float = 5.0, ridge: float = 1.0) -> Leaf | Split:
    """A tree by second-order gains; g and h are gradients and hessians of the rows."""
    value = -g.sum() / (h.sum() + ridge)
    if not depth or len(g) < 2:
        return Leaf(float(value))
    width = max((len(e) for e in edges), default=0) + 1
    flat = (b + np.arange(b.shape[1]) * width).ravel()
    by = [np.bincount(flat, np.repeat(w, b.shape[1]), b.shape[1] * width).reshape(-1, width).cumsum(axis=1) for w in (g, h)]
    gl, hl = by[0][:, :-1], by[1][:, :-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < least / 4) | (hr < least / 4)] = -1
    for f, e in enumerate(edges):
        gain[f, len(e) :] = -1
    if not gain.size or gain.max() <= 1e-6:
        return Leaf(float(value))
    f, k = np.unravel_index(gain.argmax(), gain.shape)
    low = b[:, f] <= k
    return Split(int(f), float(edges[f][k]), grow(b[low], edges, g[low], h[low], depth - 1, least, ridge), grow(b[~low], edges, g[~low], h[~low], depth - 1, least, ridge))


def predict(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.at, predict(tree.left, x), predict(tree.right, x))


@dataclass(frozen=True)
class Boosted:
    base: float
    rate: float
    trees: list = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((predict(t, x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, subsample: float, seed: int) -> Boosted:
    """Gradient-boosted trees; each round sees a seeded share of the rows. Without rows or with one label, a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    base, trees = float(np.log(share / (1 - share))), []
    if not len(y) or y.min() == y.max():
        return Boosted(base, rate)
    edges, rng = bin_edges(x), np.random.default_rng(seed)
    b, raw = binned(x, edges), np.full(len(y), base)
    for _ in range(rounds):
        p = sigmoid(raw)
        own = rng.random(len(y)) < subsample
        tree = grow(b[own], edges, (p - y)[own], (p * (1 - p))[own], depth)
        trees.append(tree)
        raw += rate * predict(tree, x)
    return Boosted(base, rate, trees)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y (pool adjacent violators), to be interpolated."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], y[order].astype(float)
    pools: list[list[float]] = []  # mean, weight, first score, last score
    for a, v in zip(s, y):
        pools.append([v, 1.0, a, a])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            m, w, _, last = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, last
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([p[0] for p in pools for _ in range(2)])
    return xs, ys
