"""Resampled quantiles, shuffle tests and fits against numpy and known values."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.functions.special import beta_cdf, beta_quantile
from weirflow.functions import draws
from weirflow.operators import adaptive, curves, factors, quantiles


def points(spark, x, y, key=None):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x double, y double")


def weight(seed, key, replicate):
    """The Poisson weight of a key, as the library draws it."""
    import hashlib

    u = int(hashlib.md5(f"{seed}:{key}:{replicate}".encode()).hexdigest()[:13], 16) / 2**52
    term, total = math.exp(-1), 0.0
    for k in range(12):
        total += term
        term /= k + 1
        if u < total:
            return k
    return 12


def test_beta():
    """Against binomial sums, which the distribution has at whole numbers."""
    for n, k, x in ((10, 3, 0.2), (200, 190, 0.97), (900, 40, 0.025)):
        tail = sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(k, n + 1))
        assert beta_cdf(x, k, n - k + 1) == pytest.approx(tail, rel=1e-9)
    assert beta_cdf([0.0, 1.0], 2.5, 3.5).tolist() == [0, 1]
    assert beta_cdf(beta_quantile([0.005, 0.5, 0.995], 3.5, 97.5), 3.5, 97.5) == pytest.approx([0.005, 0.5, 0.995])


def test_exact_quantiles(spark, monkeypatch):
    """Ties, one value, infinities, nulls and groups by null; the bins are coarser than the values."""
    monkeypatch.setattr(quantiles, "BINS", 4)
    rng = np.random.default_rng(1)
    data = {"many": rng.normal(size=301), "ties": rng.integers(0, 3, 100), "one": [5.0], None: [1.0, 2.0], "wide": [-math.inf, 0.0, 1.0, math.inf, math.inf]}
    df = spark.createDataFrame([(g, float(v)) for g, x in data.items() for v in x] + [("many", None), ("none", None), ("nan", math.nan)], "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = {(r.g, r.p): r.value for r in quantiles.exact_quantiles(df, "v", probs, ["g"]).collect()}
    assert {g for g, _ in got} == set(data)
    for g in ("many", "ties", "one", None):
        assert [got[g, p] for p in probs] == pytest.approx(np.quantile(data[g], probs))
    assert (got["wide", 0.0], got["wide", 0.5], got["wide", 1.0]) == (-math.inf, 1.0, math.inf)
    assert quantiles.exact_quantiles(df.where("false"), "v", probs).collect() == []


def test_bootstrap_is_a_repeated_sample(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(size=80).round(1)
    got = {(r.replicate, r.p): r.value for r in quantiles.bootstrap_quantiles(points(spark, x, x), "x", "k", 9, [0.1, 0.5], seed=4).collect()}
    for r in range(9):
        sample = np.repeat(x, [weight(4, k, r) for k in range(80)])
        assert [got[r, p] for p in (0.1, 0.5)] == pytest.approx(np.quantile(sample, [0.1, 0.5]))
    spread = quantiles.bootstrap_statistic(points(spark, x, x), "k", 3, lambda w: F.sum(w * F.col("x")) / F.sum(w), seed=4)
    for r in spread.collect():
        assert r.value == pytest.approx(np.repeat(x, [weight(4, k, r.replicate) for k in range(80)]).mean())


def test_weights_of_any_rate(spark):
    u = [k / 1000 for k in range(1000)]
    for rate in (0.1, 1.0, 40.0):
        got = [r[0] for r in spark.createDataFrame([(v,) for v in u], "u double").select(quantiles.poisson(F.col("u"), rate)).collect()]
        assert np.mean(got) == pytest.approx(rate, rel=0.02) and np.var(got) == pytest.approx(rate, rel=0.05)
        assert got == sorted(got)


def test_tests_of_medians(spark):
    """A shifted sample is told from the rest, one that isn't is not; groups with one side have no row."""
    rng = np.random.default_rng(3)
    rows = [(k, g, bool(k % 3 == 0), float(rng.normal() + (2 if g == "moved" and k % 3 == 0 else 0))) for k, g in enumerate(["moved", "same"] * 60)] + [(900, "lone", True, 1.0)]
    df = spark.createDataFrame(rows, "k long, g string, a boolean, x double")
    null = {r.g: r for r in quantiles.null_quantile_test(df, "x", F.col("a"), "k", 100, by=["g"]).collect()}
    deal = {r.g: r for r in quantiles.permuted_quantile_test(df, "x", F.col("a"), "k", 99, by=["g"]).collect()}
    assert set(null) == set(deal) == {"moved", "same"}
    assert null["moved"].p_value < 0.05 < null["same"].p_value and deal["moved"].p_value < 0.05 < deal["same"].p_value
    side = lambda g, a: np.median([x for _, h, b, x in rows if h == g and b == a])
    assert (null["moved"].first, null["moved"].second) == pytest.approx((side("moved", True), side("moved", False)))
    few = quantiles.permuted_quantile_test(df, "x", F.col("a"), "k", 20, by=["g"], share=(0.2, 0.2))
    assert {r.g for r in few.collect()} == {"moved", "same"}


@pytest.mark.parametrize("alternative", ["two-sided", "greater", "less"])
def test_adaptive_decides_as_a_fixed_test(spark, alternative):
    """Groups with effects from none to large: the decisions of 10,000 draws, and clear groups stop early."""
    rng = np.random.default_rng(5)
    shift = {"none": 0.0, "up": 1.5, "down": -1.5, "slight": 0.1}
    rows = [(n, g, n % 2 == 0, float(rng.normal() + (s if n % 2 == 0 else 0))) for g, s in shift.items() for n in range(120)]
    df = spark.createDataFrame(rows, "k long, g string, a boolean, x double")
    sampler = adaptive.shuffled_mean_difference("x", F.col("a"), "k", ["g"], 7)
    got = {r.g: r for r in adaptive.adaptive_test(df, sampler, ["g"], alternative=alternative, most=1024).collect()}
    for g in shift:
        x = np.array([r[3] for r in rows if r[1] == g])
        seen = x[::2].mean() - x[1::2].mean()
        dealt = rng.random((10000, len(x))) < 0.5
        under = np.mean(seen < (dealt * x).sum(1) / dealt.sum(1) - (~dealt * x).sum(1) / (~dealt).sum(1))
        p = {"greater": under, "less": 1 - under, "two-sided": 2 * min(under, 1 - under)}[alternative]
        if abs(p - 0.05) > 0.03:
            assert got[g].decided and (got[g].p_value < 0.05) == (p < 0.05), (g, p, got[g])
    assert min(r.n for r in got.values()) < 1024
    with pytest.raises(ValueError, match="alternative"):
        adaptive.adaptive_test(df, sampler, ["g"], alternative="other")


def test_adaptive_draws_only_for_the_undecided(spark):
    seen = []

    def sampler(rows, first, n):
        seen.append((first, n, sorted(r.g for r in rows.select("g").distinct().collect())))
        return rows.select("g").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1)))).withColumn("value", F.when(F.col("g") == "never", None).when(F.col("g") == "clear", 1.0).otherwise(F.when(F.col("replicate") % 20 == 0, -1.0).otherwise(1.0)))

    df = spark.createDataFrame([("clear",), ("never",), ("close",)], "g string")
    got = {r.g: (r.n, r.k, r.decided) for r in adaptive.adaptive_test(df, sampler, ["g"], alternative="greater", least=128, most=300).collect()}
    assert got == {"clear": (128, 0, True), "never": (0, 0, False), "close": (300, 15, False)}
    assert seen == [(0, 128, ["clear", "close", "never"]), (128, 128, ["close", "never"]), (256, 44, ["close", "never"])]


def test_factor_analysis_recovers_loadings(spark):
    rng = np.random.default_rng(6)
    f = np.array([[3, 0, 2, 0, 1.5, 0], [0, 1, 0, -2, 0, 1.0]])
    x = 100 + rng.normal(size=(4000, 2)) @ f + rng.normal(size=(4000, 6)) * np.array([0.5, 0.3, 0.4, 0.5, 0.3, 0.2])
    odd = [(None,), ([1.0],), ([math.nan] * 6,), ([None] * 6,), ([math.inf] * 6,)]
    df = spark.createDataFrame([(r.tolist(),) for r in x] + odd, "v array<double>").repartition(5)
    n, mean, cov = factors.vector_moments(df, "v")
    assert n == 4000 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    model = factors.fit(mean, cov, 2)
    assert np.allclose(np.abs(model.loadings), np.abs(f), atol=0.12) and np.allclose(np.sqrt(model.noise), [0.5, 0.3, 0.4, 0.5, 0.3, 0.2], atol=0.08)
    assert model.importance[0] >= model.importance[1] and np.allclose(model.covariance().diagonal(), x.var(0), rtol=1e-6)
    # likelihood by the normal density, and no nearby model is better
    dense = lambda c: -0.5 * (6 * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + np.trace(np.linalg.solve(c, cov)))
    assert model.log_likelihood == pytest.approx(dense(model.covariance()), abs=1e-6)
    assert all(dense((model.loadings + d).T @ (model.loadings + d) + np.diag(model.noise)) <= model.log_likelihood + 1e-9 for d in 0.05 * rng.normal(size=(20, 2, 6)))
    # latents by conditioning the joint normal distribution
    known, wanted = [0, 1, 2, 3], [4, 5]
    got = df.where(F.size("v") == 6).select("v", factors.project(model, "v").alias("z"), factors.project(model, "v", known).alias("part"), factors.predict(model, "v", known, wanted).alias("said")).limit(20).collect()
    c = model.covariance()
    for r in got:
        d = np.array(r.v, float) - model.mean
        assert np.allclose(r.z, model.loadings @ np.linalg.solve(c, d))
        assert np.allclose(r.part, model.loadings[:, known] @ np.linalg.solve(c[np.ix_(known, known)], d[known]))
        assert np.allclose(r.said, model.mean[wanted] + c[np.ix_(wanted, known)] @ np.linalg.solve(c[np.ix_(known, known)], d[known]))
    assert np.allclose(model.predicted_covariance(known, wanted), c[np.ix_(wanted, wanted)] - c[np.ix_(wanted, known)] @ np.linalg.solve(c[np.ix_(known, known)], c[np.ix_(known, wanted)]))
    with pytest.raises(ValueError, match="no finite vector"):
        factors.vector_moments(df.where("v is null"), "v")


def test_splines_reproduce_and_match_least_squares(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-3, 5, 200).round(1)
    at = [-3.0, -1.2, 0.0, 4.9]
    line = curves.spline_regression(points(spark, x, 2 * x - 1), "x", "y", "k", at, n=5).collect()
    assert [r.fit for r in line] == pytest.approx([2 * a - 1 for a in at]) and all(r.low == pytest.approx(r.high) for r in line)
    cube = curves.spline_regression(points(spark, x, x**3 - x), "x", "y", "k", at, n=5, natural=False, df_=5).collect()
    assert [r.fit for r in cube] == pytest.approx([a**3 - a for a in at], abs=1e-6)
    y = np.sin(x) + 0.1 * rng.normal(size=200)
    df = points(spark, x, y)
    spline = curves.spline_knots(df, "x", 5)
    assert spline.knots == pytest.approx(np.quantile(np.unique(x), np.linspace(0, 1, 6))) and spline.size == 6
    b = spline.values(x)
    got = curves.spline_regression(df, "x", "y", "k", at, n=30, seed=2).collect()
    assert [r.fit for r in got] == pytest.approx(spline.values(np.array(at)) @ np.linalg.lstsq(b, y, rcond=None)[0], abs=1e-8)
    drawn = []
    for r in range(30):
        w = np.sqrt([weight(2, k, r) for k in range(200)])
        drawn.append(spline.values(np.array(at)) @ np.linalg.lstsq(b * w[:, None], y * w, rcond=None)[0])
    assert [r.low for r in got] == pytest.approx(np.quantile(drawn, 0.025, axis=0), abs=1e-7)
    with pytest.raises(ValueError, match="one value"):
        curves.spline_knots(points(spark, [1, 1], [1, 2]), "x")


def test_robust_lines(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 10, 150)
    y = 1.5 * x + 2 + 0.1 * rng.normal(size=150)
    y[:15] += 8
    for perpendicular in (True, False):
        m, b = curves.robust_line(points(spark, x, y), "x", "y", perpendicular)
        cost = lambda m, b, p=perpendicular: np.abs(y - m * x - b).sum() / (np.hypot(m, 1) if p else 1)
        assert m == pytest.approx(1.5, abs=0.05) and b == pytest.approx(2, abs=0.2)
        assert all(cost(m, b) <= cost(m + d, b + e) + 1e-4 for d in (-0.01, 0, 0.01) for e in (-0.05, 0, 0.05))


def test_nonlinear_fits(spark):
    x = np.arange(0, 9, 0.1)
    (length, scale, offset), error = curves.exponential_decay(points(spark, x, 3 * np.exp(-x / 2.5) + 0.5), "x", "y")
    assert (length, scale, offset) == pytest.approx((2.5, 3, 0.5), rel=1e-5) and error < 1e-8
    (w, length, b), _ = curves.damped_cosine(points(spark, x, np.cos(1.3 * x) * np.exp(-x / 4 + 1)), "x", "y", (1.2, 3, 0.5))
    assert (w, length, b) == pytest.approx((1.3, 4, 1), rel=1e-5)
    (mu, sd, scale, dc), _ = curves.gaussian_bump(points(spark, x, 2 * np.exp(-0.5 * ((x - 4) / 0.7) ** 2) / (0.7 * np.sqrt(2 * np.pi)) + 0.25), "x", "y", (3.5, 1, 1, 0))
    assert (mu, abs(sd), scale, dc) == pytest.approx((4, 0.7, 2, 0.25), rel=1e-4)
    (sd, scale, dc), _ = curves.half_gaussian(points(spark, x, 2 * np.exp(-0.5 * (x / 1.4) ** 2) / (1.4 * np.sqrt(2 * np.pi))), "x", "y")
    assert (abs(sd), scale, dc) == pytest.approx((1.4, 2, 0), abs=1e-4)


def test_circular_regression(spark):
    rng = np.random.default_rng(9)
    t = rng.uniform(0, 2 * np.pi, 300)
    rows = [(k, "cycle", float(a), float(3 + 2 * np.cos(a - 1) + 0.5 * rng.normal())) for k, a in enumerate(t)] + [(k, "none", float(a), float(rng.normal())) for k, a in enumerate(t)]
    df = spark.createDataFrame(rows, "k long, g string, t double, y double")
    found = {r["g"]: r for r in curves.circular_regression(df, "t", "y", "k", ["g"], n=60, shuffles=60)}
    c = found["cycle"]
    assert c["d"] == pytest.approx(2, abs=0.15) and c["theta"] == pytest.approx(1, abs=0.1) and c["c"] == pytest.approx(3, abs=0.15)
    assert c["d_low"] < c["d"] < c["d_high"] and c["theta_low"] < 0 < c["theta_high"] and c["p_value"] == pytest.approx(1 / 61)
    b = np.stack([np.cos(t), np.sin(t), np.ones(300)], 1)
    y = np.array([r[3] for r in rows[:300]])
    w, left, *_ = np.linalg.lstsq(b, y, rcond=None)
    assert (c["a"], c["b"], c["c"]) == pytest.approx(w) and c["r2"] == pytest.approx(1 - left[0] / ((y - y.mean()) ** 2).sum())
    assert found["none"]["p_value"] > 0.05


def test_poisson_from_bounds(spark):
    """Bounds worked out once give the same numbers as the sum, beyond them too."""
    rows = spark.range(4000).select((F.col("id") / 4000).alias("u"), F.when(F.col("id") % 3 == 0, 0.25).when(F.col("id") % 3 == 1, 1.5).otherwise(20.0).alias("rate"))
    rows = rows.withColumn("bounds", quantiles.poisson_bounds(F.col("rate")))
    assert rows.where(quantiles.poisson_within(F.col("u"), F.col("bounds"), F.col("rate")) != quantiles.poisson(F.col("u"), F.col("rate"))).count() == 0


def test_draws_by_numpy_are_those_of_columns(spark):
    """Draws are made once a row and replicate, by a worker: no MD5 column is left, which Spark worked out anew wherever it was used."""
    keys = [None, "", "1", "123456", "é", "x" * 45, "y" * 80]
    df = spark.createDataFrame([(k, float(i), "a" if i % 2 else None) for i, k in enumerate(keys)], "k string, x double, g string").coalesce(1)
    want = [[r.u for r in df.withColumn("r", F.lit(n)).select(quantiles.uniform(3, "k", "r").alias("u")).collect()] for n in (-1, 0, 7, 127)]
    for part in (slice(0, 6), slice(1, 7)):
        assert [list(u) for u in draws.uniforms(3, pa.array(keys)[part], (-1, 0, 7, 127))] == [w[part] for w in want]
    made = curves.replicate_grams(df, [F.lit(1.0), F.col("x")], "x", "k", 5, 3, ["g"])
    assert "md5" not in made._jdf.queryExecution().toString()
    rows = df.collect()
    for r in made.collect():
        w = [1.0 if r.replicate < 0 else float(np.searchsorted(quantiles.unit_bounds(), next(iter(draws.uniforms(3, pa.array([q.k]), [r.replicate])))[0], "right")) for q in rows]
        own = [(v, q.x) for v, q in zip(w, rows, strict=True) if q.g == r.g]
        assert (r.n, r.c1, r.g0_1) == (sum(v for v, _ in own), sum(v * x * x for v, x in own), sum(v * x for v, x in own))
    assert "md5" not in adaptive.shuffled_mean_difference("x", F.col("x") > 2, "k", ["g"])(df, 0, 4)._jdf.queryExecution().toString()
