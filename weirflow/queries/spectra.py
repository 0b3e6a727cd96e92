"""Spectral and state-space kernels over users' series."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import spectral as sp, state as st
from ..operators.events import snippets
from ..operators import scan
from ..operators.kernels import map_series
from ..operators.welch import averaged
from ..sources.tables import load, micros, series
from .registry import SERIES, query, r6


def _samples(spark, sf_dir):
    return series(load(spark, sf_dir, "events"))


def _index(x, **columns):
    return {"i": np.arange(len(x))} | columns


@query()
def hilbert_phase(spark, sf_dir):
    def kernel(x):
        z = sp.analytic(x - x.mean())
        return _index(x, amplitude=np.abs(z), phase=sp.unwrapped(z), frequency=sp.frequency(x - x.mean()))

    return map_series(_samples(spark, sf_dir), "user_id", "i", "value", kernel, "i long, amplitude double, phase double, frequency double")


@query()
def multitaper_psd(spark, sf_dir):
    def kernel(x):
        f, p = sp.multitaper_psd(x, 3)
        return {"frequency": f, "power": p}

    return averaged(_samples(spark, sf_dir), "user_id", "i", ["value"], kernel, ["power"])


@query()
def coherence_with_time_of_day(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumn("h", F.cos(2 * F.pi() * (micros("ts") % 86400000000) / 86400e6))

    def kernel(x, y):
        f, own, other, cross = sp.cross_spectra(x, y, 3)
        return {"frequency": f, "own": own, "other": other, "re": cross.real, "im": cross.imag}

    sums = averaged(rows, "user_id", "i", ["value", "h"], kernel, ["own", "other", "re", "im"])
    return sums.select("user_id", "frequency", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("own") * F.col("other") + 1e-300)).alias("coherence"))


@query()
def cwt_power(spark, sf_dir):
    freqs = sp.log_frequencies(20, 200, 6)

    def kernel(x):
        p = np.abs(sp.morlet_power(x - x.mean(), freqs)) ** 2
        return {"frequency": freqs, "power": p.mean(1)}

    return map_series(_samples(spark, sf_dir), "user_id", "i", "value", kernel, "frequency double, power double", least=8)


@query()
def bandpass_filtered(spark, sf_dir):
    return map_series(_samples(spark, sf_dir), "user_id", "i", "value", lambda x: _index(x, y=sp.bandpass(x, 50, 200)), "i long, y double", least=16)


@query()
def upsampled(spark, sf_dir):
    return map_series(_samples(spark, sf_dir), "user_id", "i", "value", lambda x: {"i": np.arange(4 * len(x)), "y": sp.upsampled(x, 4)}, "i long, y double")


@query()
def phase_surrogate(spark, sf_dir):
    return map_series(_samples(spark, sf_dir), "user_id", "i", "value", lambda x: _index(x, y=sp.phase_randomized(x, len(x))), "i long, y double")


@query()
def circular_smooth(spark, sf_dir):
    return map_series(_samples(spark, sf_dir), "user_id", "i", "value", lambda x: _index(x, y=sp.gaussian_blur_circular(x, 2.0)), "i long, y double")


@query()
def phase_consistency(spark, sf_dir):
    """Pairwise phase consistency of series around errors: snippets are arrays, phasors are averaged by
    frequency in Spark."""
    rows = _samples(spark, sf_dir)
    snips = snippets(rows.select("user_id", "i", "value"), rows.where("event_type = 'error'"), "user_id", "i", 8)
    snips = snips.withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), F.col("trigger").cast("string")))

    def kernel(x):
        f = np.fft.rfft(sp.dpss(len(x), 2.0, 3) * (x - x.mean()), axis=1)[:, 1:]
        unit = f / (np.abs(f) + 1e-300)
        k, n = unit.shape
        return {"taper": np.repeat(np.arange(k), n), "f": np.tile(np.arange(1, n + 1), k), "re": unit.real.ravel(), "im": unit.imag.ravel()}

    units = map_series(snips, "key", "lag", "value", kernel, "taper long, f long, re double, im double", least=17)
    r = units.groupBy("taper", "f").agg((F.pow(F.avg("re"), 2) + F.pow(F.avg("im"), 2)).alias("r"), F.count("*").alias("m"))
    return r.groupBy("f").agg(r6(F.avg((F.col("m") * F.col("r") - 1) / (F.col("m") - 1))).alias("ppc"), F.max("m").alias("m"))


def _counts(spark, sf_dir):
    return _samples(spark, sf_dir).withColumn("n", F.floor(F.col("value") / 20))


#: Two states of rates 0.5 and 4: logs of moves and of Poisson likelihoods, for SQL.
_N = f"WITH RECURSIVE {SERIES.removeprefix('WITH ')}, n AS (SELECT user_id, i, floor(value / 20) AS n, floor(value / 20) * ln(0.5::DOUBLE) - 0.5 AS a, floor(value / 20) * ln(4.0::DOUBLE) - 4 AS b FROM s)"
MOVE, START, RATES = np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.5, 0.5]), np.array([0.5, 4.0])


def _loglike(x):
    return st.poisson_loglike(x, RATES)


@query(
    f"""{_N}, f AS (SELECT user_id, i, a AS va, b AS vb, 0 AS ba, 0 AS bb FROM n WHERE i = 0 UNION ALL
    SELECT n.user_id, n.i, greatest(va + ln(0.9::DOUBLE), vb + ln(0.2::DOUBLE)) + a, greatest(va + ln(0.1::DOUBLE), vb + ln(0.8::DOUBLE)) + b, (vb + ln(0.2::DOUBLE) > va + ln(0.9::DOUBLE))::INT, (vb + ln(0.8::DOUBLE) > va + ln(0.1::DOUBLE))::INT FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1),
    p AS (SELECT user_id, i, (vb > va)::INT AS state, CASE WHEN vb > va THEN bb ELSE ba END AS before FROM f WHERE i = (SELECT max(i) FROM n WHERE n.user_id = f.user_id) UNION ALL
    SELECT f.user_id, f.i, p.before, CASE WHEN p.before = 1 THEN bb ELSE ba END FROM p JOIN f ON f.user_id = p.user_id AND f.i = p.i - 1) SELECT user_id, i, state FROM p"""
)
def viterbi_states(spark, sf_dir):
    return scan.viterbi(_counts(spark, sf_dir), "user_id", "i", "n", _loglike, MOVE, START)


@query(
    f"""{_N}, f AS (SELECT user_id, i, exp(a) / (exp(a) + exp(b)) AS fa, ln((exp(a) + exp(b)) / 2) AS gain FROM n WHERE i = 0 UNION ALL
    SELECT user_id, i, qa / (qa + qb), ln(qa + qb) FROM (SELECT n.user_id, n.i, (0.9 * fa + 0.2 * (1 - fa)) * exp(a) AS qa, (0.1 * fa + 0.8 * (1 - fa)) * exp(b) AS qb FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)),
    k AS (SELECT user_id, i, 0.5::DOUBLE AS ba FROM n WHERE i = (SELECT max(i) FROM n m WHERE m.user_id = n.user_id) UNION ALL
    SELECT user_id, i, qa / (qa + qb) FROM (SELECT n.user_id, n.i - 1 AS i, 0.9 * ba * exp(a) + 0.1 * (1 - ba) * exp(b) AS qa, 0.2 * ba * exp(a) + 0.8 * (1 - ba) * exp(b) AS qb FROM k JOIN n ON n.user_id = k.user_id AND n.i = k.i AND n.i > 0))
    SELECT user_id, i, round((1 - fa) * (1 - ba) / (fa * ba + (1 - fa) * (1 - ba)), 6) + 0.0 AS busy, round(sum(gain) OVER (PARTITION BY user_id), 6) AS loglike FROM f JOIN k USING (user_id, i)"""
)
def forward_backward(spark, sf_dir):
    made = scan.posteriors(_counts(spark, sf_dir), "user_id", "i", "n", _loglike, MOVE, START)
    whole = made.groupBy("user_id").agg(F.sum("gain").alias("loglike"))
    return made.join(whole, "user_id").select("user_id", "i", r6(F.col("posterior")[1]).alias("busy"), r6("loglike").alias("loglike"))


@query()
def poisson_chain_fit(spark, sf_dir):
    def kernel(x):
        rates, move, _ = st.baum_welch(x, np.array([0.5, 4.0]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.5, 0.5]), 10)
        return {"low": [rates.min()], "high": [rates.max()], "stay": [float(np.diag(move).mean())]}

    return map_series(_counts(spark, sf_dir), "user_id", "i", "n", kernel, "low double, high double, stay double", least=20)


@query(
    f"""WITH RECURSIVE {SERIES.removeprefix('WITH ')}, f AS (SELECT user_id, i, value AS pm, 400.0::DOUBLE AS pc, value AS fm, 200.0::DOUBLE AS fc FROM s WHERE i = 0 UNION ALL
    SELECT s.user_id, s.i, fm, fc + 4, fm + (fc + 4) / (fc + 404) * (value - fm), (fc + 4) * 400 / (fc + 404) FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1),
    b AS (SELECT user_id, i, fm AS m, fc AS c, pm, pc FROM f WHERE i = (SELECT max(i) FROM s WHERE s.user_id = f.user_id) UNION ALL
    SELECT f.user_id, f.i, f.fm + f.fc / b.pc * (b.m - b.pm), f.fc + pow(f.fc / b.pc, 2) * (b.c - b.pc), f.pm, f.pc FROM b JOIN f ON f.user_id = b.user_id AND f.i = b.i - 1)
    SELECT user_id, i, round(m, 6) AS mean, round(c, 6) AS var FROM b"""
)
def kalman_smoothed(spark, sf_dir):
    one = np.eye(1)
    made = scan.kalman(_samples(spark, sf_dir), "user_id", "i", ["value"], one, one, 4 * one, 400 * one, c0=400 * one)
    return made.select("user_id", "i", r6(F.col("mean")[0]).alias("mean"), r6(F.col("cov")[0]).alias("var"))


@query()
def hidden_rates(spark, sf_dir):
    """Hidden log rates of counts that drift, by assumed densities forwards and backwards."""
    return scan.density_smoother(_counts(spark, sf_dir), "user_id", "i", "n", scan.Walk(0.98, 0.05, 0.7, 0.7, 1.0))


@query()
def hidden_trend(spark, sf_dir):
    """A level and its slope behind the counts, by peaks and curvatures."""
    move = np.array([[1.0, 1.0], [0.0, 1.0]])
    made = scan.laplace_smoother(_counts(spark, sf_dir), "user_id", "i", "n", move, np.diag([0.01, 0.001]), np.array([1.0, 0.0]), np.array([0.7, 0.0]), np.diag([1.0, 0.01]))
    return made.select("user_id", "i", F.col("mean")[0].alias("level"), F.col("mean")[1].alias("slope"))
