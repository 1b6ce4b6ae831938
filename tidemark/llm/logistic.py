"""Logistic regression on a small dense table, by Newton steps."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Coefficients, the constant last. ``ridge`` shrinks all but the constant."""
    full = with_constant(x)
    weight = np.ones(len(y)) if weight is None else weight
    penalty = np.full(full.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(full.shape[1])
    for _ in range(steps):
        p = probability(full @ beta)
        gradient = full.T @ (weight * (p - y)) + penalty * beta
        curvature = (full * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        size = np.abs(step).max()
        beta -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return beta


def with_constant(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def margin(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


def probability(margins: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margins, -60, 60)))
