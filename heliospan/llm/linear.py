"""Logistic regression on hashed features, in numpy, and Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows of (index, value) features: row i is ``bounds[i]:bounds[i + 1]``."""

    index: np.ndarray
    value: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), np.diff(self.bounds))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.bounds) - 1)
        for first in range(0, len(out), 256):  # in pieces, so the products need little memory
            bounds = self.bounds[first:first + 257]
            part = slice(bounds[0], bounds[-1])
            total = np.concatenate([[0.0], np.cumsum(weights[self.index[part]] * self.value[part])])
            out[first:first + 256] = np.diff(total[bounds - bounds[0]])
        return out

    def take(self, rows: np.ndarray) -> "Sparse":
        parts = [np.arange(self.bounds[i], self.bounds[i + 1]) for i in rows]
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return Sparse(self.index[at], self.value[at], np.concatenate([[0], np.cumsum(np.diff(self.bounds)[rows])]))


def sparse(rows: np.ndarray, index: np.ndarray, value: np.ndarray, count: int, width: int) -> Sparse:
    """Add up equal (row, index) entries."""
    keys, inverse = np.unique(rows.astype(np.int64) * width + index, return_inverse=True)
    return Sparse(keys % width, np.bincount(inverse, value, len(keys)), np.searchsorted(keys // width, np.arange(count + 1)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, width: int, steps: int = 150, rate: float = 0.5,
        penalty: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the weighted log loss; the same input gives the same model."""
    w, bias, rows = np.zeros(width), 0.0, x.rows
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    scale = weight / max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        error = (sigmoid(x.dot(w) + bias) - y) * scale
        grad = penalty * w
        for first in range(0, len(x.index), 1 << 20):
            part = slice(first, first + (1 << 20))
            grad += np.bincount(x.index[part], error[rows[part]] * x.value[part], width)
        grad = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, bias


def balanced(y: np.ndarray) -> np.ndarray:
    """Row weights that lift the rarer class, by the square root of the odds."""
    ones, zeros = max(y.sum(), 1), max((1 - y).sum(), 1)
    return np.where(y > 0, np.sqrt(zeros / ones), 1.0)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, by Newton steps on smoothed labels."""
    if len(z) == 0:
        return 1.0, 0.0
    ones, zeros = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        s = p * (1 - p) + 1e-9
        g = np.array([((p - goal) * z).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(max(a, 0.0)), float(b)


def half(keys: np.ndarray, share: int = 4) -> np.ndarray:
    """A fixed split: False for every ``share``-th row of a sample ordered by a hash."""
    return np.arange(len(keys)) % share != 0
