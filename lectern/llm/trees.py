"""Small decision-tree ensembles, fitted on the driver from a bounded labelled sample.

Trees are nested tuples (feature, threshold, left, right), left where the value is at
most the threshold; leaves are numbers. :func:`predict` applies them to an array,
:func:`as_column` to DataFrame expressions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most labelled rows a fit takes; more are refused.
MOST_ROWS = 50_000


def _grow(x, g, h, depth, least, features, rng, ridge):
    total, mass = g.sum(), h.sum()
    leaf = float(total / (mass + ridge))
    if depth == 0 or len(g) < 2 * least:
        return leaf
    best = (1e-9, None, None)
    pool = range(x.shape[1]) if features is None else rng.choice(x.shape[1], features, replace=False)
    for f in pool:
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= least) & (at <= len(v) - least)]
        if not len(at):
            continue
        gl, hl = np.cumsum(g[order])[at - 1], np.cumsum(h[order])[at - 1]
        gain = gl**2 / (hl + ridge) + (total - gl) ** 2 / (mass - hl + ridge) - total**2 / (mass + ridge)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (gain[i], f, (v[at[i] - 1] + v[at[i]]) / 2)
    if best[1] is None:
        return leaf
    _, f, cut = best
    left = x[:, f] <= cut
    go = lambda m: _grow(x[m], g[m], h[m], depth - 1, least, features, rng, ridge)
    return int(f), float(cut), go(left), go(~left)


def _rows(x, y):
    if len(y) > MOST_ROWS:
        raise ValueError(f"{len(y)} labelled rows; at most {MOST_ROWS} are taken")
    return np.asarray(x, float), np.asarray(y, float)


def forest(x, y, trees: int = 24, depth: int = 6, least: int = 3, seed: int = 1) -> list:
    """A random forest: bootstrap rows, the square root of the features at each split; leaves are shares of label 1."""
    x, y = _rows(x, y)
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        i = rng.integers(0, len(y), len(y))
        out.append(_grow(x[i], y[i], np.ones(len(i)), depth, least, max(1, round(math.sqrt(x.shape[1]))), rng, 0.0))
    return out


def boost(x, y, trees: int = 60, depth: int = 3, least: int = 5, rate: float = 0.2, ridge: float = 1.0) -> tuple[float, list]:
    """Gradient-boosted trees under log loss: (first log-odds, trees whose leaves are steps)."""
    x, y = _rows(x, y)
    p = min(max(y.mean(), 1e-6), 1 - 1e-6)
    start = math.log(p / (1 - p))
    f, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        tree = _scaled(_grow(x, y - p, p * (1 - p), depth, least, None, None, ridge), rate)
        out.append(tree)
        f = f + predict(tree, x)
    return start, out


def _scaled(tree, by):
    return tree * by if not isinstance(tree, tuple) else (*tree[:2], _scaled(tree[2], by), _scaled(tree[3], by))


def predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, predict(left, x), predict(right, x))


def as_column(tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, left, right = tree
    return F.when(features[f] <= cut, as_column(left, features)).otherwise(as_column(right, features))
