"""Populations, waves and importance against numpy and planted structure."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weirflow.operators import importance as imp, population as pop


def test_description(spark):
    rng = np.random.default_rng(1)
    data = {"a": (2 + rng.normal(size=60) + 1j * (1 + 0.3 * rng.normal(size=60))), "same": np.full(3, 1 + 1j), "zero": np.zeros(2, complex)}
    df = spark.createDataFrame([(g, float(z.real), float(z.imag)) for g, x in data.items() for z in x] + [("a", None, 1.0)], "g string, re double, im double")
    got = {r.g: r for r in pop.description(df, "re", "im", ["g"]).collect()}
    z, r = data["a"], got["a"]
    mean = z.mean()
    w = z * np.exp(-1j * np.angle(mean))
    want = {
        "n": 60, "amplitude": np.abs(z).mean(), "magnitude": abs(mean), "phase": np.angle(mean), "synchrony": abs(mean) / np.abs(z).mean(), "kuramoto": abs((z / np.abs(z)).mean()), "dispersion": np.linalg.det(np.cov(z.real, z.imag, bias=True)) ** 0.25,
        "phase_std": w.imag.std(), "amplitude_std": w.real.std(), "phase_dispersion": w.imag.std() / w.real.mean(), "amplitude_dispersion": w.real.std() / w.real.mean(), "phase_precision": w.real.mean() / w.imag.std(), "amplitude_precision": w.real.mean() / w.real.std(),
    }
    want |= {"synchrony_std": np.sqrt(-2 * np.log(want["synchrony"])), "kuramoto_std": np.sqrt(-2 * np.log(want["kuramoto"])), "synchrony_linear": 1 / (1 - want["synchrony"]), "precision": 1 / want["dispersion"], "concentration": want["amplitude"] / want["dispersion"]}
    assert {k: r[k] for k in want} == pytest.approx(want)
    assert got["same"].kuramoto == pytest.approx(1) and got["same"].dispersion == 0 and got["same"].precision is None and got["zero"].synchrony is None


def test_velocity_and_sliding_coherence(spark):
    rng = np.random.default_rng(2)
    h = np.cumsum(0.3 + 0.05 * rng.normal(size=(7, 40)), axis=1) + rng.uniform(0, 6, (7, 1))
    a = rng.uniform(0.5, 2, (7, 40))
    df = spark.createDataFrame(pd.DataFrame([(u, t, float(h[u, t] % (2 * np.pi)), float(a[u, t] * np.cos(h[u, t])), float(a[u, t] * np.sin(h[u, t]))) for u in range(7) for t in range(40)], columns=["u", "t", "h", "re", "im"]))
    d = np.diff(h, axis=1)
    got = pop.phase_velocity(df, "u", "t", "h").orderBy("t").toPandas()
    assert np.allclose(got["velocity"], np.median(d, axis=0)) and np.allclose(got["coherence"], np.cos(d - np.median(d, axis=0)).mean(0)) and (got["n"] == 7).all() and len(got) == 39
    sliding = pop.sliding_coherence(df, "u", "t", "re", "im", 6).orderBy("t").toPandas()["coherence"].to_numpy()
    top, low = (a[:, :-1] * np.cos(d - np.median(d, axis=0))).sum(0), a[:, :-1].sum(0)
    w = 0.5 + 0.5 * np.cos(np.pi * np.arange(-3, 4) / 4)
    assert np.allclose(sliding, np.convolve(top, w, "same") / np.convolve(low, w, "same"))
    gap = pop.phase_velocity(df.where("not (u = 0 and t = 5)"), "u", "t", "h").where("t in (4, 5)").collect()
    assert {r.n for r in gap} == {6}


def test_plane_waves_have_their_wavelength_direction_and_speed(spark):
    y, x = np.mgrid[:8, :9]
    frames = {k: (2 * np.pi * (0.08 * x + 0.06 * y) + 0.5 * k) for k in range(4)}
    df = spark.createDataFrame(pd.DataFrame([(k, r, c, float(v % (2 * np.pi))) for k, a in frames.items() for (r, c), v in np.ndenumerate(a)], columns=["frame", "row", "col", "value"]))
    got = pop.wave_statistics(df, "frame", spacing=0.4, rate=100.0).orderBy("frame").collect()
    for r in got:
        assert (r.local, r.planar, r.pgd, r.kuramoto_pgd) == pytest.approx((0.1 / 0.4, 0.1 / 0.4, 1, 1)) and r.wavelength == pytest.approx(4.0) and r.cv == pytest.approx(0, abs=1e-9) and r.direction == pytest.approx(np.arctan2(0.06, 0.08))
    assert [r.frequency for r in got[:3]] == pytest.approx([0.5 * 100 / (2 * np.pi)] * 3) and got[3].frequency is None and got[0].speed == pytest.approx(0.5 * 100 / (2 * np.pi) * 4.0)
    noise = spark.createDataFrame(pd.DataFrame([(0, r, c, float(v)) for (r, c), v in np.ndenumerate(np.random.default_rng(3).uniform(0, 6.28, (8, 8)))], columns=["frame", "row", "col", "value"]))
    rough = pop.wave_statistics(noise, "frame").first()
    assert rough.pgd < 0.5 and rough.planar_above is None and rough.wavelength_above is None and rough.planar > 0


def test_critical_counts(spark):
    y, x = np.mgrid[:10, :10].astype(float)
    z = {"vortex": (x - 4.3) + 1j * (y - 5.4), "plane": np.exp(0.5j * x)}
    df = spark.createDataFrame(pd.DataFrame([(f, r, c, v.real, v.imag) for f, a in z.items() for (r, c), v in np.ndenumerate(a)], columns=["frame", "row", "col", "re", "im"]))
    got = {r.frame: r for r in pop.critical_counts(df, "frame", "re", "im").collect()}
    assert got["vortex"].clockwise + got["vortex"].anticlockwise == 1 and got["plane"].clockwise == got["plane"].anticlockwise == 0
    assert set(got) == set(z)


def planted(spark, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(600, 4))
    x[:, 3] = x[:, 0] + 0.05 * rng.normal(size=600)
    y = 5 + 2 * x[:, 0] + x[:, 1] + 0.5 * rng.normal(size=600)
    return x, y, spark.createDataFrame([(int(k), int(k % 5), *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))], "key long, fold int, a double, b double, c double, d double, y double")


GROUPS = {"a": ["a"], "b": ["b"], "c": ["c"], "ad": ["a", "d"]}


def test_leaving_features_out(spark):
    x, y, df = planted(spark)
    found = imp.leave_out(df, ["a", "b", "c", "d"], "y", "fold", GROUPS, [1e-6, 1.0])
    z, t = (x - x.mean(0)) / x.std(0), y - y.mean()
    fold = np.arange(600) % 5

    def r2(use):
        best = []
        for reg in (1e-6, 1.0):
            left = 0.0
            for f in range(5):
                train, test = fold != f, fold == f
                w = np.linalg.solve(z[train][:, use].T @ z[train][:, use] + reg * np.eye(len(use)), z[train][:, use].T @ t[train])
                left += ((t[test] - z[test][:, use] @ w) ** 2).sum()
            best.append(1 - left / (t**2).sum())
        return max(best)

    for name, held in (("a", [0]), ("b", [1]), ("c", [2]), ("ad", [0, 3])):
        rest = [k for k in range(4) if k not in held]
        assert found[name] == pytest.approx({"all": r2([0, 1, 2, 3]), "without": r2(rest), "alone": r2(held), "unique": r2([0, 1, 2, 3]) - r2(rest)})
    assert found["a"]["unique"] < 0.02 and found["ad"]["unique"] > 0.5 and found["b"]["unique"] > 0.1 and abs(found["c"]["unique"]) < 0.01
    with pytest.raises(ValueError, match="no row"):
        imp.leave_out(df.where("false"), ["a"], "y", "fold", {"a": ["a"]}, [1.0])


def test_shuffled_features(spark):
    _, _, df = planted(spark)
    got = {r.features: r for r in imp.shuffled_importance(df.repartition(7), ["a", "b", "c", "d"], "y", "fold", "key", {k: GROUPS[k] for k in ("b", "c", "ad")}, [1e-6], least=48, most=96, tolerance=0.05).collect()}
    assert got["b"].decided and got["b"].p_value < 0.05 and got["ad"].p_value < 0.05 and got["c"].p_value > 0.05
    assert got["b"].k == 0


def test_numbers_and_permutations(spark):
    rows = imp.numbered(spark.range(1000).withColumn("key", (F.col("id") * 37) % 1009), "key").orderBy("key").collect()
    assert [r._row for r in rows] == list(range(1000))
    for n in (1, 2, 12, 97):
        a, b = imp.permutation(n, 3, 5)
        assert sorted((a * r + b) % n for r in range(n)) == list(range(n))


def test_shuffled_moments_by_blocks(spark, monkeypatch):
    """Rows of many small blocks get what a plain permutation gives them, in one pass for all features; a fold may be null."""
    monkeypatch.setattr(imp, "_BLOCK", 64)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(1000, 3)), rng.normal(size=1000)
    folds = [None if i % 4 == 3 else i % 4 for i in range(1000)]
    df = spark.createDataFrame([(i, f, *map(float, v), float(t)) for i, (f, v, t) in enumerate(zip(folds, x, y, strict=True))], "key long, fold int, a double, b double, c double, y double")
    rows, moves = imp.numbered(df.repartition(5), "key"), [(r, *imp.permutation(1000, 0, r)) for r in range(3, 6)]
    got = imp.shuffled_moments(rows, 1000, ["a", "b", "c"], "y", "fold", moves, 2)
    assert set(got) == {(r, f) for r, _, _ in moves for f in (0, 1, 2, None)}
    for r, a, b in moves:
        put = np.empty_like(x)
        put[(np.arange(1000) * a + b) % 1000] = x
        for f in (0, 1, 2, None):
            at = np.array([g == f for g in folds])
            assert got[r, f] == pytest.approx(put[at][:, :2].T @ np.column_stack([x, put[:, :2], y])[at])
