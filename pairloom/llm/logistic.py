"""Logistic regression by Newton steps. Deterministic."""

from collections.abc import Callable

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients that minimise the weighted mean logistic loss plus ``ridge`` times their squares."""
    n, k = x.shape
    if not n:
        return np.zeros(k)
    share = np.full(n, 1.0 / n) if weight is None else weight / weight.sum()

    def derivatives(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(x @ w)
        return x.T @ (share * (p - y)), (x * (share * p * (1 - p))[:, None]).T @ x

    return newton(k, derivatives, ridge, steps)


def newton(
    k: int, derivatives: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], ridge: float = 1e-2, steps: int = 50
) -> np.ndarray:
    """The same for ``k`` coefficients, from the gradient and curvature of the mean loss, wherever they are summed."""
    w = np.zeros(k)
    for _ in range(steps):
        grad, curve = derivatives(w)
        step = np.linalg.solve(curve + ridge * np.eye(k), grad + ridge * w)
        size = np.abs(step).max()
        w -= step if size <= 2.0 else step * (2.0 / size)
        if size < 1e-9:
            break
    return w
