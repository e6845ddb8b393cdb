"""Gradient boosted trees by histograms: logistic loss, level-wise growth.

Features are cut into at most 256 bins once. A level of a tree needs only the
sums of gradients and curvatures for each (node, feature, bin); whoever holds
the rows supplies them, so the rows may lie in an array or in Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Tree:
    """A complete binary tree: node i has the children 2 i + 1 and 2 i + 2. ``feature`` is -1 at leaves; rows with a bin above ``cut`` go right."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.feature) + 1).bit_length() - 2

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row has reached after so many levels."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.depth if levels is None else levels):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, f] > self.cut[at]), at)
        return at


@dataclass
class Booster:
    """Margins are ``base`` plus the values of the trees' leaves."""

    edges: list[np.ndarray]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Number of edges below each value; NaN goes to the first bin."""
        out = np.zeros(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], side="left"))
        return out

    def margin(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Margins of binned rows, without the base and the trees before ``first`` if that is not 0."""
        m = np.full(len(bins), 0.0 if first else self.base)
        for t in self.trees[first:]:
            m += t.value[t.nodes(bins)]
        return m

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(self.bins(x)))


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -35, 35)))


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins - 1`` distinct inner quantiles of each column."""
    out = []
    for col in x.T:
        col = col[np.isfinite(col)]
        cuts = np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf") if len(col) else np.zeros(0)
        cuts = np.unique(cuts)
        out.append(cuts[cuts < col.max()] if len(col) else cuts)
    return out


def histogram(bins: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, size: int = BINS) -> np.ndarray:
    """Sums of (g, h) for each (node, feature, bin); rows with a negative node take no part."""
    live = node >= 0
    bins, node, g, h = bins[live], node[live], g[live], h[live]
    out = np.empty((nodes, bins.shape[1], size, 2))
    for f in range(bins.shape[1]):
        at = node * size + bins[:, f]
        for k, w in enumerate((g, h)):
            out[:, f, :, k] = np.bincount(at, weights=w, minlength=nodes * size).reshape(nodes, size)
    return out


def split(hist: np.ndarray, lam: float = 1.0, least: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the best (feature, cut) and its gain; feature -1 where no split gains. Ties go to the first feature, then the lowest cut."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist.sum(axis=2, keepdims=True)
    right = total - left
    part = lambda s: s[..., 0] ** 2 / (s[..., 1] + lam)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), (part(left) + part(right) - part(total)) / 2, -np.inf)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    top = flat[np.arange(len(flat)), best]
    feature = np.where(top > 1e-9, best // gain.shape[2], -1)
    return feature, best % gain.shape[2], np.where(feature >= 0, top, 0.0)


def growing(depth: int) -> Tree:
    """A tree of one leaf with room for ``depth`` levels."""
    size = (1 << depth + 1) - 1
    return Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))


def grow_level(tree: Tree, level: int, hist: np.ndarray, eta: float, lam: float = 1.0, least: float = 1.0) -> bool:
    """Split the level's nodes by their histograms; whether any was split."""
    first = (1 << level) - 1
    feature, cut, _ = split(hist, lam, least)
    total = hist.sum(axis=2)[:, 0]
    left = np.cumsum(hist, axis=2)
    for k in range(1 << level):
        i = first + k
        if level and tree.feature[(i - 1) // 2] < 0:
            continue
        if not level:
            tree.value[i] = -eta * total[k, 0] / (total[k, 1] + lam)
        if feature[k] >= 0:
            tree.feature[i], tree.cut[i] = feature[k], cut[k]
            l = left[k, feature[k], cut[k]]  # noqa: E741
            for child, s in ((2 * i + 1, l), (2 * i + 2, total[k] - l)):
                tree.value[child] = -eta * s[0] / (s[1] + lam)
    return bool((tree.feature[first : first + (1 << level)] >= 0).any())


def grow(sums: Callable[[Tree, int], np.ndarray], depth: int, eta: float, lam: float = 1.0, least: float = 1.0) -> Tree:
    """One tree. ``sums(tree, level)`` has the histogram of the level's 2**level nodes."""
    tree = growing(depth)
    for level in range(depth):
        if not grow_level(tree, level, sums(tree, level), eta, lam, least):
            break
    return tree


#: Levels whose decisions fit into 16 bits.
DIRECT = 4


def reach(tree: Tree, level: int, width: int) -> Callable[[np.ndarray], np.ndarray]:
    """``tree.nodes`` after ``level`` levels, for bins by feature (feature, row) as whole numbers.

    Up to ``DIRECT`` levels the decisions of all inner nodes are looked up by
    feature and bin, as bits, and their sum leads to the node.
    """
    if level > DIRECT:
        return lambda bins: tree.nodes(bins.T, level)
    inner = (1 << level) - 1
    tables = np.zeros((width, 256), np.uint16)
    for i in range(inner):
        if tree.feature[i] >= 0:
            tables[tree.feature[i]] |= ((np.arange(256) > tree.cut[i]) << i).astype(np.uint16)
    code, node = np.arange(1 << inner), np.zeros(1 << inner, np.int64)
    for _ in range(level):
        node = np.where(tree.feature[node] >= 0, 2 * node + 1 + (code >> node & 1), node)
    used = [f for f in range(width) if tables[f].any()]

    def nodes(bins: np.ndarray) -> np.ndarray:
        if not used:
            return np.zeros(bins.shape[1], np.int64)
        at = tables[used[0]][bins[used[0]]]
        for f in used[1:]:
            at |= tables[f][bins[f]]
        return node[at]

    return nodes


def level_nodes(tree: Tree, bins: np.ndarray, level: int) -> np.ndarray:
    """Place of each row among a level's nodes, -1 for rows that stopped above."""
    at = tree.nodes(bins, level) - ((1 << level) - 1)
    return np.where(at >= 0, at, -1)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, eta: float = 0.2, lam: float = 1.0, least: float = 1.0, bins: int = BINS) -> Booster:
    """Boosted trees for rows in memory; without both classes the base alone."""
    w = np.ones(len(y)) if weight is None else weight
    rate = float((w * y).sum() / max(w.sum(), 1e-12)) if len(y) else 0.5
    model = Booster(edges_of(x, bins) if len(y) else [np.zeros(0)] * x.shape[1], float(np.log(np.clip(rate, 1e-6, 1 - 1e-6) / np.clip(1 - rate, 1e-6, 1))))
    if not 0 < rate < 1:
        return model
    b = model.bins(x)
    m = np.full(len(y), model.base)
    for _ in range(trees):
        p = sigmoid(m)
        g, h = w * (p - y), w * p * (1 - p)
        tree = grow(lambda t, level, g=g, h=h: histogram(b, level_nodes(t, b, level), 1 << level, g, h, bins), depth, eta, lam, least)
        if tree.feature[0] < 0:
            break
        model.trees.append(tree)
        m += tree.value[tree.nodes(b)]
    return model
