"""Small linear models fitted on the driver from a bounded sample, in numpy."""
from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def adam(gradient, weights: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam; ``gradient(weights)`` is deterministic, so the fit is repeatable."""
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        g = gradient(weights)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return weights


def platt(score: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) for which sigmoid(a * score + b) is the calibrated probability: Newton steps, Platt's smoothed targets, slope not below 0."""
    n1, n0 = int(label.sum()), int((1 - label).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    y = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([score, np.ones_like(score)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - y) + 1e-3 * (w - [1.0, 0.0]))
    return max(float(w[0]), 0.0), float(w[1])
