"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotone constraints.

A fitted model is a handful of flat node arrays, so that scoring a batch is a few gathers for each level.
"""

from __future__ import annotations

import numpy as np


class TreeNodes:
    """All trees in one set of node arrays; roots[i] is where tree i starts; a leaf points to itself."""

    def __init__(self, base, roots, feature, threshold, left, right, value, depth):
        self.base, self.depth = float(base), int(depth)
        self.roots, self.feature, self.left, self.right = (np.asarray(x, np.int32) for x in (roots, feature, left, right))
        self.threshold, self.value = np.asarray(threshold, np.float64), np.asarray(value, np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 4.0) -> TreeNodes:
    """Fit label y (0/1). monotone[j] = +1 / -1: the score never falls / rises with feature j.

    A split that breaks a constraint is not taken, and the midpoint of its children's values bounds
    everything below it, so the whole ensemble is monotone in that feature.
    """
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    monotone, p = monotone or {}, x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    prior = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    total = np.full(len(y), base)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def node() -> int:
        at = len(feature)
        for column, v in ((feature, 0), (threshold, np.inf), (left, at), (right, at), (value, 0.0)):
            column.append(v)
        return at

    def best_split(rows, g, h, low, high):
        best = (1e-6, None)
        gs, hs = g[rows].sum(), h[rows].sum()
        here = gs * gs / (hs + l2)
        for j in range(p):
            b = binned[rows, j]
            gl = np.cumsum(np.bincount(b, g[rows], len(edges[j]) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(edges[j]) + 1))[:-1]
            gr, hr = gs - gl, hs - hl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - here
            gain[(hl < least) | (hr < least)] = -1
            if j in monotone:
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                gain[monotone[j] * (vr - vl) < 0] = -1
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), (j, k, -gl[k] / (hl[k] + l2), -gr[k] / (hr[k] + l2)))
        return best[1]

    for _ in range(trees):
        q = 1 / (1 + np.exp(-total))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        roots.append(root := node())
        stack = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
        while stack:
            at, rows, level, low, high = stack.pop()
            split = best_split(rows, g, h, low, high) if level < depth and len(rows) > 1 else None
            if split is None:
                value[at] = rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
                total[rows] += value[at]
                continue
            j, k, vl, vr = split
            feature[at], threshold[at] = j, float(edges[j][k])
            left[at], right[at] = node(), node()
            bounds = [(low, high), (low, high)]
            if j in monotone:
                middle = float(np.clip((np.clip(vl, low, high) + np.clip(vr, low, high)) / 2, low, high))
                bounds = [(low, middle), (middle, high)] if monotone[j] > 0 else [(middle, high), (low, middle)]
            inside = binned[rows, j] <= k
            stack += [(left[at], rows[inside], level + 1, *bounds[0]), (right[at], rows[~inside], level + 1, *bounds[1])]
    return TreeNodes(base, roots, feature, threshold, left, right, value, depth)
