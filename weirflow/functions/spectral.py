"""Spectral kernels in numpy, for one series at a time."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=32)
def dpss(n: int, half_width: float, k: int) -> np.ndarray:
    """k Slepian tapers of n samples: eigenvectors of the tridiagonal matrix that commutes with the
    concentration problem, signs fixed so that even tapers have a positive sum and odd ones start upward."""
    t = np.arange(n)
    main = ((n - 1 - 2 * t) / 2) ** 2 * math.cos(2 * math.pi * half_width / n)
    off = t[1:] * (n - t[1:]) / 2
    _, vectors = np.linalg.eigh(np.diag(main) + np.diag(off, 1) + np.diag(off, -1))
    tapers = vectors[:, ::-1][:, :k].T.copy()
    for j, taper in enumerate(tapers):
        if (taper.sum() if j % 2 == 0 else taper[np.argmax(np.abs(taper) > 1e-7)]) < 0:
            taper *= -1
    return tapers


def analytic(x: np.ndarray) -> np.ndarray:
    """Signal and its Hilbert transform as a complex series."""
    n = len(x)
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * weight)


def unwrapped(z: np.ndarray) -> np.ndarray:
    """Phase with wrapped steps added up from the first."""
    phase = np.angle(z)
    steps = np.angle(np.exp(1j * np.diff(phase)))
    return np.concatenate([phase[:1], phase[0] + np.cumsum(steps)])


def frequency(x: np.ndarray, rate: float = 1000.0) -> np.ndarray:
    """Instantaneous frequency: wrapped phase steps, centred on samples by averaging neighbours."""
    steps = np.angle(np.exp(1j * np.diff(np.angle(analytic(x))))) * rate / (2 * np.pi)
    return np.concatenate([steps[:1], (steps[1:] + steps[:-1]) / 2, steps[-1:]])


def multitaper_psd(x: np.ndarray, k: int, rate: float = 1000.0, no_dc: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean tapered power, the zero frequency left out unless asked for."""
    n = len(x)
    power = (np.abs(np.fft.fft(dpss(n, (k + 1) / 2, k) * (x - x.mean() if no_dc else x), axis=1)) ** 2).mean(0) / rate
    freqs = np.fft.fftfreq(n, 1 / rate)
    keep = freqs > 0 if no_dc else freqs >= 0
    return freqs[keep], power[keep]


def cross_spectra(x: np.ndarray, y: np.ndarray, k: int, rate: float = 1000.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positive frequencies, both power spectra and the complex cross spectrum, averaged over tapers."""
    tapers = dpss(len(x), (k + 1) / 2, k)
    fx, fy = np.fft.fft(tapers * (x - x.mean()), axis=1), np.fft.fft(tapers * (y - y.mean()), axis=1)
    freqs = np.fft.fftfreq(len(x), 1 / rate)
    keep = freqs > 0
    return freqs[keep], (np.abs(fx) ** 2).mean(0)[keep], (np.abs(fy) ** 2).mean(0)[keep], (fx * fy.conj()).mean(0)[keep]


def coherence(x: np.ndarray, y: np.ndarray, k: int, rate: float = 1000.0) -> tuple[np.ndarray, np.ndarray]:
    """Squared multitaper coherence at positive frequencies: spectra averaged over tapers, then squared."""
    freqs, own, other, cross = cross_spectra(x, y, k, rate)
    return freqs, np.abs(cross) ** 2 / (own * other + 1e-300)


def morlet_power(x: np.ndarray, freqs: np.ndarray, w: float = 4.0, rate: float = 1000.0) -> np.ndarray:
    """(frequency, sample) complex wavelet transform with mirrored ends; wavelets have unit gain at their
    frequency."""
    n = len(x)
    padded = np.concatenate([x[::-1], x, x[::-1]])
    spectrum, at = np.fft.fft(padded), np.fft.fftfreq(3 * n, 1 / rate)
    bank = np.exp(-0.5 * (w * (at[None, :] / freqs[:, None] - 1)) ** 2) * (at > 0)
    return 2 * np.fft.ifft(spectrum * bank, axis=1)[:, n : 2 * n]


def log_frequencies(low: float, high: float, n: int) -> np.ndarray:
    return 2 ** np.linspace(math.log2(low), math.log2(high), n)


@lru_cache(maxsize=64)
def butterworth(order: int, low: float | None, high: float | None, rate: float, stop: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth filter: low-, high-, band-pass or band-stop by the
    bilinear transform of the prewarped prototype."""
    warp = lambda f: 2 * rate * math.tan(math.pi * f / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if low is None:
        w = warp(high)
        zeros, poles, gain = np.zeros(0), poles * w, w**order
    elif high is None:
        w = warp(low)
        zeros, poles, gain = np.zeros(order), w / poles, np.real(1 / np.prod(-poles))
    elif stop:
        a, b = warp(low), warp(high)
        half, centre = (b - a) / (2 * poles), a * b
        root = np.sqrt(half**2 - centre)
        zeros, poles, gain = np.concatenate([np.full(order, 1j), np.full(order, -1j)]) * math.sqrt(centre), np.concatenate([half + root, half - root]), 1.0
    else:
        a, b = warp(low), warp(high)
        half, centre = poles * (b - a) / 2, a * b
        root = np.sqrt(half**2 - centre)
        zeros, poles, gain = np.zeros(order), np.concatenate([half + root, half - root]), (b - a) ** order
    k = 2 * rate
    gain = gain * np.real(np.prod(k - zeros) / np.prod(k - poles))
    dz = np.concatenate([(k + zeros) / (k - zeros), -np.ones(len(poles) - len(zeros))])
    return np.real(gain * np.poly(dz)), np.real(np.poly((k + poles) / (k - poles)))


def recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Transposed direct form filter from a state."""
    out, z = np.empty(len(x)), state.astype(float).copy()
    for t, v in enumerate(x):
        y = b[0] * v + z[0]
        z[:-1] = b[1:-1] * v + z[1:] - a[1:-1] * y
        z[-1] = b[-1] * v - a[-1] * y
        out[t] = y
    return out


def steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State of the filter under a long constant input of 1."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[: n - 1, 1:] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def bandpass(x: np.ndarray, low: float | None, high: float | None, rate: float = 1000.0, order: int = 4, zero_phase: bool = True) -> np.ndarray:
    """Butterworth filter with half the series reflected at each end; forward and back if zero_phase."""
    b, a = butterworth(order, low, high, rate)
    m = max(1, len(x) // 2)
    y = np.concatenate([x[:m][::-1], x, x[-m:][::-1]])
    start = steady(b, a)
    y = recursive(b, a, y, start * y[0])
    if zero_phase:
        y = recursive(b, a, y[::-1], start * y[-1])[::-1]
    return y[m : m + len(x)]


def phase_randomized(x: np.ndarray, seed: int) -> np.ndarray:
    """Surrogate with the amplitude spectrum of x and random phases."""
    f = np.fft.rfft(x)
    phase = np.random.default_rng(seed).uniform(0, 2 * np.pi, len(f))
    phase[0] = 0
    if len(x) % 2 == 0:
        phase[-1] = 0
    return np.fft.irfft(np.abs(f) * np.exp(1j * phase), len(x))


def upsampled(x: np.ndarray, factor: int = 4) -> np.ndarray:
    """Fourier upsampling of the series less its end-to-end line, which is added back."""
    n = len(x)
    line = np.linspace(x[0], x[-1], n)
    fine = np.interp(np.arange(n * factor) / factor, np.arange(n), line)
    f = np.fft.rfft(np.concatenate([x - line, (x - line)[::-1]]))
    return np.fft.irfft(f, 2 * n * factor)[: n * factor] * factor + fine


def ppc(snippets: np.ndarray, k: int, rate: float = 1000.0) -> tuple[np.ndarray, np.ndarray]:
    """Multitaper pairwise phase consistency of snippets (rows), debiased for their number."""
    m, n = snippets.shape
    x = snippets - snippets.mean(1, keepdims=True)
    tapers = dpss(n, (k + 1) / 2, k)
    f = np.fft.fft(tapers[:, None, :] * x[None], axis=2)
    unit = f / (np.abs(f) + 1e-300)
    r = (np.abs(unit.mean(1)) ** 2).mean(0)
    freqs = np.fft.fftfreq(n, 1 / rate)
    return freqs[freqs > 0], ((m * r - 1) / (m - 1))[freqs > 0]


def gaussian_blur_circular(x: np.ndarray, sigma: float) -> np.ndarray:
    """Wrap-around smoothing with the kernel exp(-d^2 / sigma^2), normalised."""
    n = len(x)
    d = np.minimum(np.arange(n), n - np.arange(n))
    kernel = np.exp(-((d / sigma) ** 2))
    return np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(kernel / kernel.sum()), n)
