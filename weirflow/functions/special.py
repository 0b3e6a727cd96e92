"""Beta distribution in numpy, for intervals of resampled p-values."""

from __future__ import annotations

from math import lgamma

import numpy as np


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, terms: int = 400) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    x, a, b = (np.array(v, float) for v in np.broadcast_arrays(x, a, b))
    turn = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    inside = (x > 0) & (x < 1)
    z = np.where(inside, x, 0.5)
    log = np.vectorize(lgamma, otypes=[float])
    front = np.exp(log(a + b) - log(a) - log(b) + a * np.log(z) + b * np.log1p(-z)) / a
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (a + b) * z / (a + 1)) < tiny, tiny, 1 - (a + b) * z / (a + 1))
    total = d.copy()
    for m in range(1, terms):
        for step in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total = total * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    got = np.where(inside, front * total, np.where(x <= 0, 0.0, 1.0))
    return np.where(turn, 1 - got, got)


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the distribution reaches p, by bisection."""
    p, a, b = np.broadcast_arrays(np.asarray(p, float), a, b)
    low, high = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(60):
        middle = (low + high) / 2
        under = beta_cdf(middle, a, b) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2
