"""Linear support vector machines by dual coordinate descent (Hsieh et al., 2008)."""

from __future__ import annotations

import numpy as np


def train(x: np.ndarray, positive: np.ndarray, c: float = 10.0, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """Weights, the last for the bias, of the hinge-loss machine that separates ``positive`` from the other rows."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    y = np.where(positive, 1.0, -1.0)
    norm = (x * x).sum(axis=1) + 1e-12
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
