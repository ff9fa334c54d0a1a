"""Gradient-boosted regression trees for small samples, and their evaluation as a column expression.

Trees are complete: every inner node of depth below ``depth`` splits, and a branch that stopped early repeats its leaf.
A tree is then three short arrays (feature and cut of each inner node, value of each leaf), and a forest one array
literal that a fold walks through: the plan holds numbers, not branches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


@dataclass
class Boosted:
    """Sum of trees on the log-odds scale."""

    depth: int
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += _apply(t, x, self.depth)
        return out

    def column(self, x: Column) -> Column:
        """Probability from an array of features."""
        rows = [{"f": t.feature.tolist(), "c": t.cut.tolist(), "v": t.value.tolist()} for t in self.trees]
        forest = F.from_json(F.lit(json.dumps(rows)), "array<struct<f:array<int>,c:array<double>,v:array<double>>>")
        inner = 2**self.depth - 1

        def walk(t: Column) -> Column:
            level = lambda i, _: F.when(F.get(x, F.get(t["f"], i)) <= F.get(t["c"], i), 2 * i + 1).otherwise(2 * i + 2)
            return F.get(t["v"], F.aggregate(F.array(*map(F.lit, range(self.depth))), F.lit(0), level) - inner)

        total = F.aggregate(forest, F.lit(float(self.start)), lambda acc, t: acc + walk(t))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _apply(t: Tree, x: np.ndarray, depth: int) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for _ in range(depth):
        at = np.where(x[np.arange(len(x)), t.feature[at]] <= t.cut[at], 2 * at + 1, 2 * at + 2)
    return t.value[at - len(t.feature)]


def _grow(tree: Tree, node: int, x: np.ndarray, g: np.ndarray, h: np.ndarray, rate: float, least: int) -> None:
    inner = len(tree.feature)
    total_g, total_h = g.sum(), h.sum()
    if node >= inner:
        tree.value[node - inner] = round(float(rate * total_g / (total_h + 1.0)), 6)
        return
    best = (1e-6, -1, 0.0)
    for f in range(x.shape[1]) if len(g) >= 2 * least else ():
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        sg, sh = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if len(at):
            gain = sg[at] ** 2 / (sh[at] + 1) + (total_g - sg[at]) ** 2 / (total_h - sh[at] + 1) - total_g**2 / (total_h + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
    if best[1] < 0:  # no split: both branches end in the same leaf
        for child in (2 * node + 1, 2 * node + 2):
            _grow(tree, child, x[:0].reshape(0, x.shape[1]), g, h, rate, len(g) + 1)
        return
    tree.feature[node], tree.cut[node] = best[1], best[2]
    low = x[:, best[1]] <= best[2]
    _grow(tree, 2 * node + 1, x[low], g[low], h[low], rate, least)
    _grow(tree, 2 * node + 2, x[~low], g[~low], h[~low], rate, least)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 32, depth: int = 3, rate: float = 0.3, least: int = 4) -> Boosted:
    """Logistic loss, Newton leaves, exact splits; the same sample always gives the same trees."""
    share = min(max(float(y.mean()), 0.01), 0.99)
    model = Boosted(depth, float(round(np.log(share / (1 - share)), 6)))
    raw = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        inner = 2**depth - 1
        tree = Tree(np.zeros(inner, np.int64), np.zeros(inner), np.zeros(inner + 1))
        _grow(tree, 0, x, y - p, p * (1 - p), rate, least)
        model.trees.append(tree)
        raw += _apply(tree, x, depth)
    return model
