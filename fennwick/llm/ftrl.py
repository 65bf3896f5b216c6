"""Sparse multinomial logistic regression: follow the regularised leader with elastic-net penalties, then calibration."""

from __future__ import annotations

import numpy as np

Row = tuple[np.ndarray, np.ndarray]  # distinct feature numbers, their values


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FTRL:
    """Per-coordinate FTRL-proximal over ``dim`` features and ``classes`` classes; the last feature is the intercept."""

    def __init__(self, dim: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((dim + 1, classes)), np.zeros((dim + 1, classes))

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n)

    def fit(self, rows: list[Row], labels: np.ndarray, epochs: int = 3, seed: int = 1) -> FTRL:
        dim, order = len(self.z) - 1, np.random.default_rng(seed)
        for _ in range(epochs):
            for r in order.permutation(len(rows)):
                idx, x = np.append(rows[r][0], dim), np.append(rows[r][1], 1.0)
                z, n = self.z[idx], self.n[idx]
                w = self._weights(z, n)
                p = softmax(x @ w)
                p[labels[r]] -= 1
                g = x[:, None] * p
                grown = n + g * g
                self.z[idx] = z + g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
                self.n[idx] = grown
        return self


def scores(rows: list[Row], weights: np.ndarray) -> np.ndarray:
    """Raw class scores of each row."""
    out = np.repeat(weights[-1:], len(rows), axis=0)
    for r, (idx, x) in enumerate(rows):
        if len(idx):
            out[r] += x @ weights[idx]
    return out


def temperature(raw: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that minimises the log loss of softmax(raw / T), by golden-section search on log T."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(raw / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
