"""Gradient-boosted trees for small tables, trained in numpy and written out as Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


@dataclass
class Trees:
    """Log-odds: start plus the leaves of all trees; a row goes low where feature <= cut."""

    start: float
    trees: list[Node] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += _leaf(t, x)
        return out

    def probability(self, features: list[Column]) -> Column:
        total = F.lit(self.start)
        for t in self.trees:
            total = total + _expression(t, features)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _leaf(t: Node, x: np.ndarray) -> np.ndarray:
    if t.low is None:
        return np.full(len(x), t.value)
    return np.where(x[:, t.feature] <= t.cut, _leaf(t.low, x), _leaf(t.high, x))


def _expression(t: Node, features: list[Column]) -> Column:
    if t.low is None:
        return F.lit(float(t.value))
    return F.when(features[t.feature] <= F.lit(float(t.cut)), _expression(t.low, features)).otherwise(_expression(t.high, features))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, penalty: float) -> Node:
    g, h = grad.sum(), hess.sum()
    leaf = Node(value=-g / (h + penalty))
    best = (1e-6, -1, 0.0)
    if depth:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, gs, hs = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
            at = np.flatnonzero(v[1:] != v[:-1])
            if not len(at):
                continue
            gain = gs[at] ** 2 / (hs[at] + penalty) + (g - gs[at]) ** 2 / (h - hs[at] + penalty) - g**2 / (h + penalty)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(v[at[k]] + v[at[k] + 1]) / 2)
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    leaf.feature, leaf.cut = best[1], best[2]
    leaf.low = _grow(x[low], grad[low], hess[low], depth - 1, penalty)
    leaf.high = _grow(x[~low], grad[~low], hess[~low], depth - 1, penalty)
    return leaf


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, penalty: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(float(np.log(share / (1 - share))))
    margin = np.full(len(x), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, p - y, p * (1 - p), depth, penalty)
        _scale(tree, rate)
        model.trees.append(tree)
        margin += _leaf(tree, x)
    return model


def _scale(t: Node, rate: float) -> None:
    t.value *= rate
    if t.low is not None:
        _scale(t.low, rate)
        _scale(t.high, rate)


def calibrated_bound(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability at which the rows at or above it have the precision; at least 0.5."""
    p = 1 / (1 + np.exp(-margin))
    order = np.argsort(-p, kind="stable")
    exact = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(exact >= precision)
    return float(max(0.5, p[order[fine[-1]]])) if len(fine) else 1.1
