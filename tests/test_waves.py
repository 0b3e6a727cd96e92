"""Filters in state, peaks and coherence against whole-series kernels and numpy."""

import numpy as np
import pandas as pd
import pytest

from weirflow.functions import spectral as sp
from weirflow.operators import coherence as co, filters


def frame(spark, data):
    return spark.createDataFrame(pd.DataFrame([(s, i, float(v)) for s, x in data.items() for i, v in enumerate(x)], columns=["s", "i", "x"])).repartition(3)


def back(df, s, column="y"):
    return df.where(df.s == s).orderBy("i").toPandas()[column].to_numpy()


@pytest.mark.parametrize(("low", "high"), [(45, 55), (100, 300)])
def test_band_stop_has_half_power_at_its_edges(low, high):
    b, a = sp.butterworth(4, low, high, 1000.0, True)
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 1000)) / np.polyval(a, np.exp(2j * np.pi * f / 1000)))
    assert gain(low) == pytest.approx(0.5**0.5) and gain(high) == pytest.approx(0.5**0.5) and gain(0) == pytest.approx(1) and gain(499) == pytest.approx(1, abs=1e-6)
    centre = 1000 / np.pi * np.arctan(np.sqrt(np.tan(np.pi * low / 1000) * np.tan(np.pi * high / 1000)))
    assert gain(centre) < 1e-6


def test_filters_in_state_equal_the_whole(spark):
    rng = np.random.default_rng(1)
    data = {"a": 3 + rng.normal(size=500), "b": rng.normal(size=40), "one": [2.0]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for low, high, stop in ((None, 100, False), (100, None, False), (50, 200, False), (50, 200, True)):
            made = filters.bandpass(frame(spark, data), "s", "i", "x", low, high, stop=stop, pad=250)
            b, a = sp.butterworth(4, low, high, 1000.0, stop)
            for s in ("a", "b"):
                x = np.array(data[s])
                m = min(250, len(x))
                y = np.concatenate([x[:m][::-1], x, x[-m:][::-1]])
                start = sp.steady(b, a)
                y = sp.recursive(b, a, y, start * y[0])
                y = sp.recursive(b, a, y[::-1], start * y[-1])[::-1][m : m + len(x)]
                assert np.allclose(back(made, s), y)
            assert made.where("s = 'one'").count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError, match="band"):
        filters.bandpass(frame(spark, data), "s", "i", "x", None, None)


def test_line_noise_goes_and_the_rest_stays(spark):
    rng = np.random.default_rng(2)
    t = np.arange(1500) / 1000
    line = np.sin(2 * np.pi * 60 * t) + 0.5 * np.sin(2 * np.pi * 120 * t)
    slow = {s: np.sin(2 * np.pi * f * t) for s, f in (("a", 7), ("b", 11))}
    df = frame(spark, {s: x + g * line for (s, x), g in zip(slow.items(), (2.0, -1.0), strict=True)})
    made = filters.without_line_noise(df, "s", "i", "x", overtones=3)
    for s, x in slow.items():
        assert np.abs(back(made, s) - x)[300:-300].max() < 0.05
    hum = {s: 0.1 * rng.normal(size=1500) + g * np.sin(2 * np.pi * 60 * t) for s, g in (("a", 2.0), ("b", 1.0))}
    made = filters.without_common_noise(frame(spark, hum), "s", "i", "x")
    for s, x in hum.items():
        power = lambda z: np.abs(np.fft.rfft(z))[90]
        assert power(back(made, s)) < 0.05 * power(x)
    positive = filters.nonnegative_bandpass(frame(spark, {"a": rng.exponential(size=300) ** 3}), "s", "i", "x", None, 80)
    assert back(positive, "a").min() > -1


def test_peak_widths(spark):
    x = [0, 1, 4, 10, 6, 2, 3, 8, 7, 4.5, 5, 1, 0, 9]
    got = sorted(tuple(r)[1:] for r in filters.peak_widths(frame(spark, {"a": x, "low": [5, 4, 3]}), "s", "i", "x").where("s = 'a'").collect())
    # the peak at 7 falls below half at 5 (a valley) and at 11; the one at 10 is under a half of the highest on neither side of its own valley
    assert got == [(3, 10.0, 2, 5, 3), (7, 8.0, 6, 9, 3), (10, 5.0, 9, 11, 2), (13, 9.0, 12, 13, 1)]
    inner = filters.peak_widths(frame(spark, {"a": x}), "s", "i", "x", least=0.6, ends=False).collect()
    assert sorted(r.peak for r in inner) == [3, 7]
    spectrum = frame(spark, {"a": x})
    assert [tuple(r) for r in filters.peak_within(spectrum, ["s"], "i", "x", 4, 11).collect()] == [("a", 7, 8.0)]
    assert [tuple(r) for r in filters.peak_within(spectrum, ["s"], "i", "x", 8, 13, local=True).collect()] == [("a", 10, 5.0)]
    assert filters.peak_within(spectrum, ["s"], "i", "x", 20, 30).collect() == []


def mixed(seed, trials):
    """Two channels that share a part, and one that is alone."""
    rng, rows, kept = np.random.default_rng(seed), [], {}
    for trial, (start, n) in trials.items():
        z = rng.normal(size=(4, n))
        x = {"a": z[0] + z[3], "b": z[1] + z[3], "c": z[2]}
        kept[trial] = np.array(list(x.values()))
        rows += [(trial, c, start + t, float(v)) for c, xs in x.items() for t, v in enumerate(xs)]
    return pd.DataFrame(rows, columns=["trial", "channel", "t", "value"]), kept


def test_coherence_equals_numpy(spark):
    size, tapers, names = 32, 3, ["a", "b", "c"]
    data, kept = mixed(3, {"p": (0, 700), "q": (5, 333), "short": (0, 20)})
    df = spark.createDataFrame(data).repartition(4)
    weights = sp.dpss(size, (tapers + 1) / 2, tapers)
    windows = {}
    for trial, x in kept.items():
        first = {"p": 0, "q": 5, "short": 0}[trial]
        for chunk in range(-(-first // 16), (first + x.shape[1]) // 16):
            part = x[:, chunk * 16 - first : chunk * 16 - first + size]
            if part.shape[1] == size:
                f = np.fft.rfft((part - part.mean(1, keepdims=True))[:, None] * weights, axis=2)
                windows[trial, chunk] = np.einsum("utk,vtk->uvk", f, f.conj())
    for group in co.GROUPS:
        made = co.coherence(co.cross_spectra(df, names, size, tapers, group), names, size, 1000.0, group).toPandas()
        keys = {k: [w for w in windows if all({"trial": w[0], "chunk": w[1]}[c] == v for c, v in zip(co.GROUPS[group], k, strict=True))] for k in {tuple({"trial": w[0], "chunk": w[1]}[c] for c in co.GROUPS[group]) for w in windows}}
        assert len(made) == len(keys) * 3 * 17
        by = made.set_index([*co.GROUPS[group], "first", "second", "frequency"])["coherence"]
        for k, own in list(keys.items())[:4]:
            s = sum(windows[w] for w in own)
            want = np.abs(s[0, 1]) ** 2 / np.real(s[0, 0] * s[1, 1])
            assert np.allclose([by[(*k, "a", "b", 1000.0 * j / size)] for j in range(17)], want)
    whole = co.coherence(co.cross_spectra(df, names, size, tapers), names, size)
    rows = {(r["first"], r["second"]): r for r in whole.groupBy("first", "second").agg({"coherence": "avg", "n": "max"}).collect()}
    assert rows["a", "b"]["avg(coherence)"] == pytest.approx(0.25, abs=0.06) and rows["a", "c"]["avg(coherence)"] < 0.05
    assert rows["a", "b"]["max(n)"] == tapers * len(windows)
    pop = co.population(co.cross_spectra(df, names, size, tapers), names, size).orderBy("frequency").collect()
    s = sum(windows.values())
    for r, m in zip(pop, np.moveaxis(s, 2, 0), strict=True):
        p = np.sqrt(np.real(np.diag(m)))
        assert r.eigen == pytest.approx((np.linalg.eigvalsh(m / np.outer(p, p))[-1] - 1) / 2) and r["mean"] == pytest.approx(np.mean([np.abs(m[i, j]) ** 2 / (p[i] * p[j]) ** 2 for i, j in ((0, 1), (0, 2), (1, 2))]))


def test_chance_of_coherence(spark):
    """Unrelated channels exceed the level of five percent in about five percent of the frequencies."""
    rng = np.random.default_rng(4)
    data = pd.DataFrame([(t, c, i, float(v)) for t in range(200) for c in "xy" for i, v in enumerate(rng.normal(size=16))], columns=["trial", "channel", "t", "value"])
    made = co.coherence(co.cross_spectra(spark.createDataFrame(data), ["x", "y"], 16, 4, "trial"), ["x", "y"], 16, group="trial").where("frequency > 0.1 and frequency < 0.4").toPandas()
    assert (made["coherence"] > co.chance_level(4)).mean() == pytest.approx(0.05, abs=0.03) and (made["p_value"] < 0.05).mean() == pytest.approx(0.05, abs=0.03)
    assert co.cross_spectra(spark.createDataFrame(data), ["x", "y"], 32).count() == 0
    with pytest.raises(ValueError, match="even"):
        co.cross_spectra(spark.createDataFrame(data), ["x"], 5)


def test_sums_are_sent_before_they_fill_a_task_and_windows_are_not_shuffled_twice(spark, monkeypatch):
    data, _ = mixed(3, {k: (0, 100) for k in "pqrstu"})
    df = spark.createDataFrame(data).repartition(2)
    names = ["a", "b", "c"]
    frame = lambda group: co.coherence(co.cross_spectra(df, names, 32, 3, group), names, 32, group=group).toPandas().sort_values([*co.GROUPS[group], "first", "second", "frequency"]).reset_index(drop=True)
    whole = {g: frame(g) for g in ("trial", "window")}
    # two groups of sums are all that a task may hold
    monkeypatch.setattr(co, "HELD", 2 * 9 * 17)
    for g, want in whole.items():
        pd.testing.assert_frame_equal(frame(g), want)

    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join")

    held = co.chunks(df, names, 0, 16, 16)
    made = co.coherence(co.cross_spectra(df, names, 32, 3, "window"), names, 32, group="window")
    assert joins(made) == joins(held)
