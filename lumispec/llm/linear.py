"""Linear models on sparse indicators: naive Bayes scaling, dual coordinate descent for the hinge loss, and Platt's calibration."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of feature numbers with values, one row after another."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None = None) -> None:
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        self.ids = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.values = np.concatenate(values) if values else np.ones(len(self.ids))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.ids[self.ends[i] : self.ends[i + 1]], self.values[self.ends[i] : self.ends[i + 1]]

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.ids] * self.values)])
        return sums[self.ends[1:]] - sums[self.ends[:-1]]


def log_count_ratio(x: Sparse, y: np.ndarray, n_features: int, alpha: float = 1.0) -> np.ndarray:
    """log of how much likelier each indicator is among rows of class 1 than of class 0, each with alpha added."""
    of = np.repeat(y > 0, np.diff(x.ends))
    p, q = (alpha + np.bincount(x.ids[of == side], minlength=n_features) for side in (True, False))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def hinge_dual(x: Sparse, y: np.ndarray, n_features: int, cost: np.ndarray, passes: int = 20, seed: int = 0) -> np.ndarray:
    """Weights of the L2-regularised hinge loss (cost for each row), by dual coordinate descent; y is 1 or -1."""
    w, dual, order = np.zeros(n_features), np.zeros(len(x)), np.random.default_rng(seed)
    squares = np.array([float((v * v).sum()) for v in (x.row(i)[1] for i in range(len(x)))])
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(x)):
            if squares[i] <= 0:
                continue
            ids, values = x.row(i)
            slope = y[i] * float(w[ids] @ values) - 1
            new = min(max(dual[i] - slope / squares[i], 0.0), cost[i])
            if new != dual[i]:
                w[ids] += (new - dual[i]) * y[i] * values
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-4:
            break
    return w


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b with P(1) = 1 / (1 + exp(-(a m + b))), fitted by Newton's method to targets smoothed as Platt has them."""
    up, down = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    scale = float(np.abs(margins).mean()) or 1.0
    z = np.stack([margins / scale, np.ones(len(margins))], 1)
    t = np.array([0.0, np.log((up + 1) / (down + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -35, 35)))
        g = z.T @ (p - target)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), g)
        t -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0] / scale), float(t[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
