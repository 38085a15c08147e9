"""Linear models fitted with numpy on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def adam(gradient, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimises by full gradients; the same on every run."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression on (possibly soft) targets."""
    total = max(weight.sum(), 1e-9)
    return adam(lambda w: x.T @ (weight * (sigmoid(x @ w) - y)) / total + l2 * w, np.zeros(x.shape[1], x.dtype), steps, rate)


def calibration(g: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the decision values that make them probabilities of label 1."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(np.std(g)), 1e-6)
    w = logistic(np.stack([g / spread, np.ones(len(g))], 1), target, np.ones(len(g)), 0.0, 1500, 0.05)
    return float(max(w[0], 0.0) / spread), float(w[1])
