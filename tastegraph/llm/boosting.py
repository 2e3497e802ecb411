"""Gradient-boosted regression trees for the logistic loss, with quantile-binned features, and Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """trees: (feature, threshold, leaf values) of complete binary trees of equal depth, as arrays."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, bins: int = 32) -> Boosted:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    width = bins + 1
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, inner = np.full(len(y), base), 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, t, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for at in range(inner):
            mine = np.flatnonzero(node == at)
            if len(mine):
                best = (1e-9, 0, np.inf)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.cumsum(np.bincount(binned[mine, j], g[mine], width))[: len(c)]
                    hs = np.cumsum(np.bincount(binned[mine, j], h[mine], width))[: len(c)]
                    gt, ht = g[mine].sum(), h[mine].sum()
                    gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, c[k])
                f[at], t[at] = best[1], best[2]
                node[mine] = 2 * at + 1 + (x[mine, f[at]] > t[at])
        leaf = np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + l2) * rate
        margin += leaf[node - inner]
        features.append(f)
        thresholds.append(t)
        leaves.append(leaf)
    return Boosted(base, np.array(features), np.array(thresholds), np.array(leaves))


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, steps: int = 300) -> Boosted:
    """Platt's scaling on rows that the trees haven't seen."""
    r, a, b = model.raw(x), 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * r + b, -30, 30)))
        h = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * r).sum() + 1e-3 * (a - 1), (p - y).sum()])
        hess = np.array([[(h * r * r).sum() + 1e-3, (h * r).sum()], [(h * r).sum(), h.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.offset = float(a), float(b)
    return model
