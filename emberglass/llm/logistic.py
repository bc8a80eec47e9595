"""A small logistic regression with calibrated probabilities, fitted on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 40) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    pull = np.full(z.shape[1], ridge)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + pull * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(h + 1e-9 * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic | None:
        """Weights from two thirds of the rows, calibration (Platt) from the rest; None unless both classes are in either part."""
        hold = np.arange(len(x)) % 3 == 2
        if min(y[~hold].sum(), (1 - y[~hold]).sum(), y[hold].sum(), (1 - y[hold]).sum()) < 1:
            return None
        mean, scale = x[~hold].mean(axis=0), x[~hold].std(axis=0) + 1e-6
        w = _newton((x[~hold] - mean) / scale, y[~hold], np.ones((~hold).sum()), ridge)
        raw = ((x[hold] - mean) / scale) @ w[:-1] + w[-1]
        n1, n0 = y[hold].sum(), (1 - y[hold]).sum()
        aim = np.where(y[hold] > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's targets
        cal = _newton(raw[:, None], aim, np.ones(len(raw)), 1e-3)
        return cls(mean, scale, w, max(float(cal[0]), 1e-3), float(cal[1]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))
