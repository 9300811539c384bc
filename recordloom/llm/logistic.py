"""Logistic regression on the driver, for the few features of a bounded sample."""

from __future__ import annotations

import numpy as np


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of every column; a constant column keeps its scale."""
    scale = x.std(axis=0)
    return x.mean(axis=0), np.where(scale > 0, scale, 1.0)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients, the constant first, by Newton steps. A class that is
    missing leaves the constant at its smoothed share."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    beta = np.zeros(width + 1)
    beta[0] = np.log(share / (1 - share))
    if n == 0 or y.min() == y.max():
        return beta
    design = np.column_stack([np.ones(n), x])
    penalty = np.full(width + 1, ridge * n / 100)
    penalty[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - penalty * beta
        weight = np.maximum(p * (1 - p), 1e-9)
        hessian = (design * weight[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta
