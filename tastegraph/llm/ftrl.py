"""FTRL-proximal logistic regression over hashed binary features.

Training takes a bounded, documented sample of labelled rows, runs in one executor
task and yields only the weights that L1 left non-zero, so that the model is small
enough to broadcast (at most 2**bits entries, in practice some thousands).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Ftrl:
    """bits: log2 of the hash space. alpha, beta: per-coordinate rates. l1, l2: regularisation."""

    bits: int = 22
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    steps: int = 24_000  # single-row updates in all; epochs follow from the sample's size
    max_epochs: int = 30

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows: (indices, values) of each example, without repeated indices. Returns (indices, weights).

        Index 0 is the bias and is added here; it isn't regularised by L1.
        An empty sample gives an empty model (score 0.5).
        """
        size = 1 << self.bits
        z, n, w = np.zeros(size, np.float64), np.zeros(size, np.float64), np.zeros(size, np.float64)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0)
        epochs = int(min(self.max_epochs, max(3, self.steps // len(rows))))
        rng = np.random.default_rng(7)
        bias_z = bias_n = bias = 0.0
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                at, x = rows[r]
                zi, ni = z[at], n[at]
                wi = np.where(np.abs(zi) <= self.l1, 0.0, (np.sign(zi) * self.l1 - zi) / ((self.beta + np.sqrt(ni)) / self.alpha + self.l2))
                bias = -bias_z / ((self.beta + bias_n**0.5) / self.alpha)
                g0 = 1.0 / (1.0 + np.exp(-np.clip(wi @ x + bias, -35, 35))) - labels[r]
                g = g0 * x
                sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / self.alpha
                z[at] = zi + g - sigma * wi
                n[at] = ni + g * g
                bias_z += g0 - ((bias_n + g0 * g0) ** 0.5 - bias_n**0.5) / self.alpha * bias
                bias_n += g0 * g0
        keep = np.flatnonzero(np.abs(z) > self.l1)
        w = (np.sign(z[keep]) * self.l1 - z[keep]) / ((self.beta + np.sqrt(n[keep])) / self.alpha + self.l2)
        bias = -bias_z / ((self.beta + bias_n**0.5) / self.alpha)
        return np.concatenate([[-1], keep]), np.concatenate([[bias], w])


class Model:
    """Weights for scoring: ``index -1`` is the bias."""

    def __init__(self, bits: int, indices: np.ndarray, weights: np.ndarray):
        self.bits = bits
        self.bias = float(weights[indices == -1].sum())
        self.dense = np.zeros(1 << bits, np.float32)
        self.dense[indices[indices >= 0]] = weights[indices >= 0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
