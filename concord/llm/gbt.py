"""Gradient-boosted trees on feature histograms, flattened into arrays; logistic loss.

Fitting is deterministic: no sampling, ties go to the lower feature and threshold. Constant or empty input gives
a model without splits whose score is the share of positive labels (one half if there are no rows).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees: ``feature`` -1 marks a leaf; a row goes left where its value is at most ``threshold``."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values of each row of x, all trees at once."""
        if not len(self.roots):
            return np.full(len(x), self.bias)
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[node]
            low = x[rows, np.maximum(feature, 0)] <= self.threshold[node]
            node = np.where(feature < 0, node, np.where(low, self.left[node], self.right[node]))
        return self.bias + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges between bins: midpoints of neighbouring values at the quantiles."""
    values = np.unique(column)
    if len(values) <= 1:
        return np.empty(0)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    cuts = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    at = np.minimum(np.searchsorted(values, cuts, side="right"), len(values) - 1)
    return np.unique((cuts + values[at]) / 2)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """``least``: rows in a leaf at least."""
    n, width = x.shape
    rate_of = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate_of / (1 - rate_of)))
    edges = [bin_edges(x[:, f], bins) for f in range(width)] if n else []
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1) if n and width else np.zeros((n, width), int)
    offset = np.arange(width) * (bins + 1)
    margin = np.full(n, bias)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, step: np.ndarray) -> int:
        node = len(feature)
        for to, x_ in zip((feature, threshold, left, right, value), (-1, 0.0, -1, -1, 0.0)):
            to.append(x_)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if level < depth and len(rows) >= 2 * least:
            cells = (binned[rows] + offset).ravel()
            size = width * (bins + 1)
            sums = [np.bincount(cells, np.repeat(v[rows], width), size).reshape(width, -1).cumsum(1)[:, :-1] for v in (g, h, np.ones(n))]
            gl, hl, nl = sums
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            f, b = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[f, b] > best[0] and b < len(edges[f]):
                best = (gain[f, b], f, b)
        if best[1] < 0:
            value[node] = float(-rate * gs / (hs + l2))
            step[rows] = value[node]
            return node
        _, f, b = best
        low = binned[rows, f] <= b
        feature[node], threshold[node] = int(f), float(edges[f][b])
        left[node] = grow(rows[low], g, h, level + 1, step)
        right[node] = grow(rows[~low], g, h, level + 1, step)
        return node

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h, step = p - y, np.maximum(p * (1 - p), 1e-9), np.zeros(n)
        before = len(feature)
        roots.append(grow(np.arange(n), g, h, 0, step))
        if len(feature) == before + 1 and abs(value[-1]) < 1e-9:
            roots.pop()
            break
        margin += step
    as_ = lambda x_, kind: np.array(x_, kind)
    return Trees(as_(roots, np.int64), as_(feature, np.int64), as_(threshold, float), as_(left, np.int64), as_(right, np.int64), as_(value, float), bias, depth)
