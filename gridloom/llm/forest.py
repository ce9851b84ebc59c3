"""Small tree ensembles in numpy: a random forest that compiles to SQL, and gradient boosting."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Node i: x[feature[i]] <= threshold[i] goes to left[i], else right[i]; leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            low = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)

    def sql(self, names: list[str], i: int = 0) -> str:
        """The tree as nested CASE expressions over the named features."""
        if self.feature[i] < 0:
            return f"{self.value[i]:.6f}D"
        then, other = self.sql(names, self.left[i]), self.sql(names, self.right[i])
        return f"CASE WHEN {names[self.feature[i]]} <= {self.threshold[i]:.9g}D THEN {then} ELSE {other} END"


def _grow(
    x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, tried: int | None, rng: np.random.Generator, penalty: float
) -> Tree:
    """A tree of greatest gain in G**2 / (H + penalty); leaf values are G / (H + penalty)."""
    nodes: list[list[float]] = []

    def build(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        G, H = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, -1, -1, G / (H + penalty)])
        if level == depth or len(rows) < 2 * least:
            return me
        best = (1e-9, -1, 0.0)
        features = np.arange(x.shape[1]) if tried is None else rng.choice(x.shape[1], tried, replace=False)
        for f in features:
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v = x[order, f]
            gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            gain = gl**2 / (hl + penalty) + (G - gl) ** 2 / (H - hl + penalty) - G**2 / (H + penalty)
            gain[v[1:] == v[:-1]] = -1
            gain[: least - 1] = -1
            gain[len(gain) - least + 1 :] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = build(rows[low], level + 1)
            nodes[me][3] = build(rows[~low], level + 1)
        return me

    build(np.arange(len(x)), 0)
    t = np.array(nodes)
    return Tree(t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4])


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 6, least: int = 3, seed: int = 7) -> list[Tree]:
    """Trees on bootstrap samples, each split over a random root of the features; leaves hold shares of 1."""
    rng = np.random.default_rng(seed)
    tried = max(2, int(np.sqrt(x.shape[1])) + 1)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        out.append(_grow(x[rows], y[rows].astype(float), np.ones(len(rows)), depth, least, tried, rng, 1e-9))
    return out


@dataclass
class Boosted:
    """Log-odds as a start plus a sum of trees."""

    start: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, least: int = 10, seed: int = 7) -> Boosted:
    """Gradient boosting of the logistic loss with second-order leaf values."""
    rng = np.random.default_rng(seed)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        t = _grow(x, y - p, p * (1 - p), depth, least, None, rng, 1.0)
        t.value *= rate
        trees.append(t)
        score += t.predict(x)
    return Boosted(start, trees)
