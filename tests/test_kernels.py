"""Numpy kernels against direct formulas and known values."""

import itertools
import math

import numpy as np
import pytest

from weirflow.functions import spectral as sp, state as st


def test_dpss_are_orthonormal_and_concentrated():
    tapers = sp.dpss(64, 3.0, 4)
    assert np.allclose(tapers @ tapers.T, np.eye(4), atol=1e-9)
    f = np.abs(np.fft.fft(tapers, 4096, axis=1)) ** 2
    inside = np.abs(np.fft.fftfreq(4096)) <= 3.0 / 64
    assert (f[:, inside].sum(1) / f.sum(1) > 0.98).all()


def test_sinusoid_peaks_at_its_frequency():
    t = np.arange(500) / 1000
    x = np.sin(2 * np.pi * 80 * t)
    f, p = sp.multitaper_psd(x, 3)
    assert abs(f[p.argmax()] - 80) <= 4
    freqs = np.arange(20.0, 200, 10)
    assert freqs[np.abs(sp.morlet_power(x, freqs)).mean(1).argmax()] == 80
    assert np.allclose(sp.frequency(x)[50:-50], 80, atol=0.5)
    assert np.allclose(np.abs(sp.analytic(x)), 1, atol=1e-6)


def test_coherence_of_shared_noise():
    rng = np.random.default_rng(0)
    shared = rng.normal(size=2000)
    _, same = sp.coherence(shared, shared + 0.01 * rng.normal(size=2000), 8)
    _, none = sp.coherence(shared, rng.normal(size=2000), 8)
    assert same.mean() > 0.99 and none.mean() < 0.3


@pytest.mark.parametrize(("low", "high"), [(None, 50.0), (50.0, None), (40.0, 60.0)])
def test_butterworth_has_half_power_at_its_edges(low, high):
    b, a = sp.butterworth(4, low, high, 1000.0)
    gain = lambda f: abs(np.polyval(b[::-1], np.exp(-2j * np.pi * f / 1000)) / np.polyval(a[::-1], np.exp(-2j * np.pi * f / 1000)))
    for f in (low, high):
        if f:
            assert gain(f) == pytest.approx(math.sqrt(0.5), rel=1e-6)
    assert gain(1.0 if low is None else 450.0 if high is None else math.sqrt(low * high)) == pytest.approx(1, abs=1e-2)


def test_bandpass_keeps_and_drops():
    t = np.arange(1000) / 1000
    x = np.sin(2 * np.pi * 20 * t) + np.sin(2 * np.pi * 200 * t)
    y = sp.bandpass(x, 100, 300)
    assert np.abs(y - np.sin(2 * np.pi * 200 * t))[200:-200].max() < 0.05


def test_surrogate_keeps_the_spectrum():
    x = np.random.default_rng(1).normal(size=101)
    y = sp.phase_randomized(x, 3)
    assert np.allclose(np.abs(np.fft.rfft(x)), np.abs(np.fft.rfft(y)))


def test_upsampled_passes_through_the_samples():
    x = np.cos(np.linspace(0, 3, 50))
    assert np.abs(sp.upsampled(x, 4)[::4] - x).max() < 0.01


def test_ppc_of_locked_and_free_phases():
    rng, t = np.random.default_rng(2), np.arange(100)
    locked = np.sin(2 * np.pi * 0.1 * t) + 0.05 * rng.normal(size=(40, 100))
    free = np.sin(2 * np.pi * 0.1 * t + rng.uniform(0, 2 * np.pi, (40, 1)))
    f, a = sp.ppc(locked, 1)
    _, b = sp.ppc(free, 1)
    k = np.abs(f - 100).argmin()
    assert a[k] > 0.95 and abs(b[k]) < 0.2


def chain():
    rng = np.random.default_rng(4)
    return rng.normal(size=(6, 2)), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([0.6, 0.4])


def paths(loglike, move, start):
    for p in itertools.product(range(2), repeat=len(loglike)):
        yield p, math.log(start[p[0]]) + sum(loglike[k, s] for k, s in enumerate(p)) + sum(math.log(move[a, b]) for a, b in itertools.pairwise(p))


def test_viterbi_and_posteriors_against_all_paths():
    loglike, move, start = chain()
    every = list(paths(loglike, move, start))
    assert tuple(st.viterbi(loglike, move, start)) == max(every, key=lambda x: x[1])[0]
    posterior, like = st.forward_backward(loglike, move, start)
    weight = np.exp([w for _, w in every])
    assert like == pytest.approx(math.log(weight.sum()))
    for k in range(6):
        assert posterior[k, 1] == pytest.approx(sum(w for (p, _), w in zip(every, weight, strict=True) if p[k]) / weight.sum())


def test_baum_welch_raises_likelihood():
    rng = np.random.default_rng(5)
    counts = np.concatenate([rng.poisson(1, 60), rng.poisson(6, 60)]).astype(float)
    rates, move, start = np.array([2.0, 4.0]), np.array([[0.6, 0.4], [0.4, 0.6]]), np.array([0.5, 0.5])
    before = st.forward_backward(st.poisson_loglike(counts, rates), move, start)[1]
    r, m, s = st.baum_welch(counts, rates, move, start, 30)
    assert st.forward_backward(st.poisson_loglike(counts, r), m, s)[1] > before and sorted(r)[1] == pytest.approx(6, abs=1)


def test_kalman_equals_the_joint_gaussian():
    y = np.array([[1.0], [2.0], [np.nan], [0.5]])
    a, b, q, r = np.array([[0.9]]), np.array([[1.0]]), np.array([[0.5]]), np.array([[0.3]])
    m, c = st.kalman_smooth(y, a, b, q, r, np.zeros(1), np.eye(1))
    prior = np.zeros((4, 4))
    var = [1.0]
    for _ in range(3):
        var.append(0.81 * var[-1] + 0.5)
    for i in range(4):
        for j in range(4):
            prior[i, j] = var[min(i, j)] * 0.9 ** abs(i - j)
    seen = [0, 1, 3]
    gain = prior[:, seen] @ np.linalg.inv(prior[np.ix_(seen, seen)] + 0.3 * np.eye(3))
    assert np.allclose(m[:, 0], gain @ y[seen, 0]) and np.allclose(c[:, 0, 0], np.diag(prior - gain @ prior[seen]))


def test_gaussian_product():
    m, c = st.multiply_gaussians(np.array([0.0]), np.eye(1), np.array([2.0]), np.eye(1))
    assert m[0] == pytest.approx(1) and c[0, 0] == pytest.approx(0.5)


def test_windows_cover_whole_series(spark):
    from pyspark.sql import functions as F

    from weirflow.operators import welch

    sizes = {1: 5, 2: 64, 3: 65, 4: 200, 5: 97}
    rows = [(u, i, float(i)) for u, n in sizes.items() for i in range(n)]
    got = welch.windows(spark.createDataFrame(rows, "u int, i long, x double").repartition(7), "u", "i", ["x"]).collect()
    for u, n in sizes.items():
        mine = sorted((r.start, r.x) for r in got if r.u == u)
        assert all(x == [float(s + k) for k in range(min(n, 64))] for s, x in mine)
        assert {v for _, x in mine for v in x} == set(map(float, range(n)))
        assert [s for s, _ in mine] == sorted({*range(0, max(n - 64, 0) + 1, 32), max(n - 64, 0)})
    flat = spark.range(300).select(F.lit(1).alias("u"), F.col("id").alias("i"), F.sin(F.col("id") * F.lit(2 * 3.141592653589793 / 8)).alias("x"))
    power = welch.averaged(flat, "u", "i", ["x"], lambda x: dict(zip(("frequency", "power"), sp.multitaper_psd(x, 3), strict=True)), ["power"]).orderBy(F.desc("power")).first()
    assert abs(power.frequency - 125) <= 1000 / 64


def test_camel_to_snake(spark):
    from weirflow.functions import text

    pairs = [("eventTypeOf", "event_type_of"), ("HTTPServer2Go", "http_server2_go"), ("A", "a"), ("aB", "a_b"), ("getURL", "get_url"), ("", ""), ("x1Y", "x1_y")]
    rows = spark.createDataFrame([(a,) for a, _ in pairs], "s string").coalesce(1)
    assert [r[0] for r in rows.select(text.camel_to_snake(rows["s"])).collect()] == [b for _, b in pairs]


def test_results_of_series_are_sent_together():
    from weirflow.operators import kernels

    made = [(k, {"x": np.full(n, float(n)), "y": [n] * n}) for k, n in (("a", 3), (None, 2), ("b", 0), ("c", kernels.TOGETHER), ("d", 1))]
    frames = list(kernels._sent("k", iter(made)))
    assert [len(f) for f in frames] == [kernels.TOGETHER + 5, 1]
    assert frames[0]["k"].iloc[:6].tolist() == ["a"] * 3 + [None] * 2 + ["c"] and frames[0]["y"].iloc[:6].tolist() == [3, 3, 3, 2, 2, kernels.TOGETHER]
    assert list(kernels._sent("k", iter([]))) == []
