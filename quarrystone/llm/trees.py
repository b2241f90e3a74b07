"""Histogram trees in numpy: gradient boosting and a random forest, flattened into arrays.

Fitting runs on the driver over a bounded labelled sample; scoring takes the flat arrays anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in one set of arrays.  Node i of a tree is a leaf where ``feature[i]`` is -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values plus base for each row: every row of every tree steps down at once."""
        n, t = len(x), len(self.roots)
        at = np.broadcast_to(self.roots, (n, t)).copy()
        rows = np.arange(n)[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f < 0, at, np.where(go, self.left[at], self.right[at]))
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30, 30)))

    def sql(self, columns: list[str]) -> str:
        """The same sum as one SQL expression."""

        def node(i: int) -> str:
            if self.feature[i] < 0:
                return f"{float(self.value[i])!r}D"
            test = f"{columns[self.feature[i]]} <= {float(self.threshold[i])!r}D"
            return f"(CASE WHEN {test} THEN {node(self.left[i])} ELSE {node(self.right[i])} END)"

        return " + ".join([f"{self.base!r}D", *(node(r) for r in self.roots)])


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b of a feature holds the values in (edge[b-1], edge[b]]."""
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1).astype(np.int32)


class _Grower:
    def __init__(self, codes: np.ndarray, edges: list[np.ndarray], depth: int, least: int, l2: float) -> None:
        self.codes, self.edges, self.depth, self.least, self.l2 = codes, edges, depth, least, l2
        self.f: list[int] = []
        self.t: list[float] = []
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.v: list[float] = []

    def node(self, value: float) -> int:
        for a, x in ((self.f, -1), (self.t, 0.0), (self.lo, 0), (self.hi, 0), (self.v, value)):
            a.append(x)
        return len(self.f) - 1

    def grow(self, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, rate: float, pick, level: int = 0) -> int:
        """Split where the histogram gain is largest; ties go to the smaller feature and bin."""
        g, h = grad[rows].sum(), hess[rows].sum()
        at = self.node(rate * g / (h + self.l2))
        if level == self.depth or len(rows) < 2 * self.least:
            return at
        best = (1e-9, -1, -1)
        for j in pick():
            n = len(self.edges[j]) + 1
            if n < 2:
                continue
            c = self.codes[rows, j]
            gl, hl = np.cumsum(np.bincount(c, grad[rows], n))[:-1], np.cumsum(np.bincount(c, hess[rows], n))[:-1]
            nl = np.cumsum(np.bincount(c, minlength=n))[:-1]
            gain = gl**2 / (hl + self.l2) + (g - gl) ** 2 / (h - hl + self.l2) - g**2 / (h + self.l2)
            gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
            b = int(np.argmax(gain))
            if gain[b] > best[0]:
                best = (float(gain[b]), j, b)
        if best[1] < 0:
            return at
        _, j, b = best
        go = self.codes[rows, j] <= b
        self.f[at], self.t[at] = j, float(self.edges[j][b])
        self.lo[at] = self.grow(rows[go], grad, hess, rate, pick, level + 1)
        self.hi[at] = self.grow(rows[~go], grad, hess, rate, pick, level + 1)
        return at

    def trees(self, roots: list[int], base: float) -> Trees:
        return Trees(
            np.array(roots, np.int64), np.array(self.f, np.int64), np.array(self.t), np.array(self.lo, np.int64),
            np.array(self.hi, np.int64), np.array(self.v), self.depth, base,
        )


def fit_boosted(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 5, l2: float = 1.0
) -> Trees:
    """Gradient boosting on log loss.  One class or no rows gives a constant score."""
    share = float(y.mean()) if len(y) else 0.5
    base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if not len(y) or share in (0.0, 1.0):
        return _Grower(np.zeros((0, 1), np.int32), [], 0, 1, 1.0).trees([], base)
    edges = bin_edges(x, bins)
    grower = _Grower(binned(x, edges), edges, depth, least, l2)
    raw, rows, roots = np.full(len(y), base), np.arange(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grower.grow(rows, y - p, p * (1 - p), rate, lambda: range(x.shape[1])))
        raw = base + _Grower.trees(grower, roots, 0.0).raw(x)
    return grower.trees(roots, base)


def fit_forest(x: np.ndarray, y: np.ndarray, count: int = 15, depth: int = 6, bins: int = 32, least: int = 3, seed: int = 7) -> Trees:
    """Random forest: bootstrap rows, sqrt(features) tried at each split; leaf values are class shares / count."""
    if not len(y):
        raise ValueError("a forest needs labelled rows")
    rng = np.random.default_rng(seed)
    edges = bin_edges(x, bins)
    grower = _Grower(binned(x, edges), edges, depth, least, 1e-9)
    some = max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    ones, roots = np.ones(len(y)), []
    for _ in range(count):
        rows = np.sort(rng.integers(0, len(y), len(y)))
        pick = lambda: np.sort(rng.choice(x.shape[1], some, replace=False))
        roots.append(grower.grow(rows, y.astype(float), ones, 1.0 / count, pick))
    return grower.trees(roots, 0.0)
