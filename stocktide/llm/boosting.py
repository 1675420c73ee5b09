"""Gradient-boosted trees for two classes with monotonic constraints, flattened into numpy node arrays.

Training works on a bounded sample in the driver: histograms of at most BINS quantile bins, logistic loss, second-order
gains. Along a feature with constraint +1 (-1) the score never falls (rises): a split whose values are in the wrong order is
not taken, and the middle of its values bounds all values below it on either side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class FlatTrees:
    """All trees' nodes in five arrays; feature -1 marks a leaf. roots: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x, all rows and trees one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            over = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(f < 0, at, np.where(over, self.right[at], self.left[at]))
        return self.base + self.value[at].sum(axis=1)


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 80, depth: int = 4, rate: float = 0.15, least_rows: int = 15, ridge: float = 1.0) -> FlatTrees:
    """y: 0 or 1, both present. monotone: +1, -1 or 0 for each column of x."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # bin k: e[k-1] < x <= e[k]
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left_depth: int) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        here = len(nodes)
        own = float(np.clip(-total_g / (total_h + ridge), low, high))
        nodes.append([-1, 0.0, -1, -1, rate * own])
        best = (1e-6, -1, 0, 0.0, 0.0)
        if left_depth and len(rows) >= 2 * least_rows:
            for f, sign in enumerate(monotone):
                if not len(edges[f]):
                    continue
                b, size = binned[rows, f], len(edges[f]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                loss = lambda v, gs, hs: gs * v + 0.5 * (hs + ridge) * v * v
                gain = loss(own, total_g, total_h) - loss(vl, gl, hl) - loss(vr, gr, hr)
                gain[(nl < least_rows) | (len(rows) - nl < least_rows) | (sign * (vr - vl) < 0)] = -np.inf
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        if best[1] >= 0:
            _, f, k, vl, vr = best
            middle, sign = (vl + vr) / 2, monotone[f]
            below = binned[rows, f] <= k
            nodes[here][:2] = [f, float(edges[f][k])]
            nodes[here][2] = grow(rows[below], g, h, middle if sign < 0 else low, middle if sign > 0 else high, left_depth - 1)
            nodes[here][3] = grow(rows[~below], g, h, middle if sign > 0 else low, middle if sign < 0 else high, left_depth - 1)
        else:
            raw[rows] += nodes[here][4]
        return here

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -4.0, 4.0, depth))
    columns = list(zip(*nodes, strict=True))
    return FlatTrees(*(np.array(c, t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True)), np.array(roots), base, depth)
