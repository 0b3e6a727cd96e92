"""State-space kernels in numpy, for one series at a time."""

from __future__ import annotations

import numpy as np


def viterbi(loglike: np.ndarray, transition: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """Most likely states of (time, state) log-likelihoods; transition[i, j] goes from i to j."""
    t, n = loglike.shape
    logt = np.log(transition + 1e-300)
    best, back = np.log(initial + 1e-300) + loglike[0], np.zeros((t, n), int)
    for k in range(1, t):
        step = best[:, None] + logt
        back[k] = step.argmax(0)
        best = step.max(0) + loglike[k]
    path = np.empty(t, int)
    path[-1] = best.argmax()
    for k in range(t - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def forward_backward(loglike: np.ndarray, transition: np.ndarray, initial: np.ndarray) -> tuple[np.ndarray, float]:
    """Posterior state probabilities and the log-likelihood of the series."""
    t, n = loglike.shape
    top = loglike.max(1, keepdims=True)
    like = np.exp(loglike - top)
    forward, scale = np.empty((t, n)), np.empty(t)
    now = initial * like[0]
    for k in range(t):
        if k:
            now = (forward[k - 1] @ transition) * like[k]
        scale[k] = now.sum()
        forward[k] = now / scale[k]
    back = np.ones(n)
    posterior = forward.copy()
    for k in range(t - 2, -1, -1):
        back = transition @ (back * like[k + 1]) / scale[k + 1]
        posterior[k] = forward[k] * back
    return posterior / posterior.sum(1, keepdims=True), float(np.log(scale).sum() + top.sum())


def poisson_loglike(counts: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """(time, state) log-likelihood up to the factorial."""
    return counts[:, None] * np.log(rates)[None] - rates[None]


def baum_welch(counts: np.ndarray, rates: np.ndarray, transition: np.ndarray, initial: np.ndarray, rounds: int = 20):
    """Rates, transitions and initial probabilities of a Poisson chain by expectation maximisation."""
    for _ in range(rounds):
        loglike = poisson_loglike(counts, rates)
        posterior, _ = forward_backward(loglike, transition, initial)
        like = np.exp(loglike - loglike.max(1, keepdims=True))
        pairs = posterior[:-1, :, None] * transition[None] * like[1:, None, :]
        pairs /= np.maximum(pairs.sum(2, keepdims=True), 1e-300)
        joint = (pairs * posterior[:-1, :, None]).sum(0)
        transition = joint / np.maximum(joint.sum(1, keepdims=True), 1e-300)
        initial = posterior[0]
        rates = np.maximum((posterior * counts[:, None]).sum(0) / np.maximum(posterior.sum(0), 1e-300), 1e-9)
    return rates, transition, initial


def multiply_gaussians(m1: np.ndarray, c1: np.ndarray, m2: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the normalised product of two densities."""
    gain = c1 @ np.linalg.inv(c1 + c2)
    return m1 + gain @ (m2 - m1), c1 - gain @ c1


def kalman_smooth(y: np.ndarray, a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray, m0: np.ndarray, c0: np.ndarray):
    """Means and covariances given all measurements y = b x + noise(r), x' = a x + noise(q). A row of NaN
    is no measurement."""
    t, d = len(y), len(m0)
    means, covs, pm, pc = np.empty((t, d)), np.empty((t, d, d)), np.empty((t, d)), np.empty((t, d, d))
    m, c = m0, c0
    for k in range(t):
        if k:
            m, c = a @ m, a @ c @ a.T + q
        pm[k], pc[k] = m, c
        if np.isfinite(y[k]).all():
            gain = c @ b.T @ np.linalg.inv(b @ c @ b.T + r)
            m, c = m + gain @ (y[k] - b @ m), c - gain @ b @ c
        means[k], covs[k] = m, c
    for k in range(t - 2, -1, -1):
        back = covs[k] @ a.T @ np.linalg.inv(pc[k + 1])
        means[k] = means[k] + back @ (means[k + 1] - pm[k + 1])
        covs[k] = covs[k] + back @ (covs[k + 1] - pc[k + 1]) @ back.T
    return means, covs


def linear_filter(a: np.ndarray, c: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Causal z += a z + c x."""
    z, out = start.astype(float).copy(), np.empty((len(x), len(start)))
    for k, v in enumerate(x):
        z = z + a @ z + c * v
        out[k] = z
    return out


def ornstein_uhlenbeck(x0: float, sigma: float, tau: float, dt: float, n: int, seed: int) -> np.ndarray:
    """Euler path of a relaxing random walk; tau infinite gives a Wiener process."""
    noise = np.random.default_rng(seed).normal(0, 1, n)
    x = np.empty(n)
    now = x0
    for k in range(n):
        x[k] = now
        now = now - (0 if np.isinf(tau) else now * dt / tau) + sigma * np.sqrt(dt) * noise[k]
    return x
