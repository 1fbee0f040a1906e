"""Linear hinge-loss models by dual coordinate descent, over sparse rows of features."""

from __future__ import annotations

import numpy as np


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, c: np.ndarray, epochs: int = 20, seed: int = 0, tolerance: float = 1e-3) -> np.ndarray:
    """Weights (the last one is the bias) of min |w|^2 / 2 + sum c_i max(0, 1 - y_i w x_i).

    ``rows``: indices and values of each row; ``labels`` are +1 or -1; ``c``: the cost of each row. The dual has one
    variable a row, between 0 and its cost; each step solves for one and adds the change to w (Hsieh et al. 2008, hinge loss).
    It ends when no variable's slope is further than ``tolerance`` from an optimum's.
    """
    n, w, alpha = len(rows), np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows]) + 1.0
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in draw.permutation(n):
            at, v = rows[i]
            y = labels[i]
            slope = y * (w[at] @ v + w[size]) - 1.0
            old = alpha[i]
            if old <= 0.0 <= slope or old >= c[i] and slope <= 0.0:
                continue
            worst = max(worst, abs(slope))
            new = min(max(old - slope / square[i], 0.0), c[i])
            step = (new - old) * y
            w[at] += step * v
            w[size] += step
            alpha[i] = new
        if worst < tolerance:
            break
    return w


def platt(scores: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a score + b))), by Newton's method on smoothed 0/1 targets."""
    pos, neg = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([scores, np.ones_like(scores)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 1e-3), float(w[1])
