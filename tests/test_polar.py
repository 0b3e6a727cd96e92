"""Polar distributions and waveform widths against numpy and made waves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.functions import waveform as wf
from weirflow.operators import polar


def samples(spark, data):
    return spark.createDataFrame([(g, float(z.real), float(z.imag)) for g, x in data.items() for z in x] + [("a", None, 1.0), ("a", 0.0, 0.0)], "g string, re double, im double")


def test_distributions(spark):
    rng = np.random.default_rng(1)
    z = (3 + rng.normal(size=400)) * np.exp(1j * (0.8 + 0.3 * rng.normal(size=400)))
    df = samples(spark, {"a": z, "b": 2 * z[:5]})
    got = polar.complex_gaussian(df, "re", "im", ["g"]).where("g = 'a'").first()
    e, v = np.linalg.eigh(np.cov(z.real, z.imag))
    assert (got.x, got.y, got.major, got.minor) == pytest.approx((z.real.mean(), z.imag.mean(), e[1] ** 0.5, e[0] ** 0.5))
    assert abs(np.cos(got.tilt) * v[0, 1] + np.sin(got.tilt) * v[1, 1]) == pytest.approx(1)
    whole = polar.log_polar_gaussian(df.where("g = 'a'"), "re", "im").first()
    theta = np.angle(z.mean())
    w = np.abs(z) / np.abs(z).sum()
    x, y = np.log(np.abs(z)), np.angle(z * np.exp(-1j * theta)) / 4
    c = np.cov(x, y, aweights=w)
    assert (whole.phase, whole.log_amplitude, whole.turn) == pytest.approx((theta, w @ x, w @ y)) and whole.major**2 + whole.minor**2 == pytest.approx(np.trace(c)) and (whole.major * whole.minor) ** 2 == pytest.approx(np.linalg.det(c))
    said = polar.log_polar_statistics(df, "re", "im", ["g"]).where("g = 'a'").first()
    assert (said.log_mean, said.log_std, said.low) == pytest.approx((x.mean(), x.std(), np.exp(x.mean() - x.std()))) and said.phase_std == pytest.approx(np.sqrt(-2 * np.log(abs(z.mean()) / np.abs(z).mean())))
    ring = polar.complex_gaussian(df, "re", "im", ["g"]).where("g = 'a'").select(F.posexplode(polar.ellipse(*map(F.col, ("x", "y", "major", "minor", "tilt")), 50)).alias("k", "p")).select("p.x", "p.y").toPandas().to_numpy()
    d = ring - [z.real.mean(), z.imag.mean()]
    assert np.allclose(np.einsum("ni,ij,nj->n", d, np.linalg.inv(np.cov(z.real, z.imag)), d), 1)


def test_axes_and_concentrations(spark):
    rng = np.random.default_rng(2)
    sign = rng.choice([-1, 1], 500, p=[0.3, 0.7])
    z = sign * (2 + 0.2 * rng.normal(size=500)) * np.exp(1j * (0.4 + 0.1 * rng.normal(size=500)))
    got = polar.signed_polar_statistics(samples(spark, {"a": z}), "re", "im", ["g"]).first()
    assert got.axis == pytest.approx(0.4, abs=0.02) and got.mean == pytest.approx((sign * np.abs(z)).mean(), abs=1e-6) and got.axis_std == pytest.approx(0.1, abs=0.02)
    for k in (0.5, 2.0, 20.0):
        h = rng.vonmises(1.0, k, 20000)
        fit = polar.von_mises(spark.createDataFrame([(float(v),) for v in h], "h double"), "h").first()
        assert fit.location == pytest.approx(1.0, abs=0.1) and fit.concentration == pytest.approx(k, rel=0.06)
    one = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "a double, b double").agg(polar.mean_cosine(F.col("a"), F.col("b"))).first()[0]
    assert one == pytest.approx((np.cos(1) + 1) / 2)


def test_waveforms(spark):
    wave = [0.0, 0.5, 2.0, 2.5, 1.0, -1.0, -6.0, -8.0, -5.0, -1.0, 1.0, 3.0, 4.0, 3.0, 1.0, 0.0]
    df = spark.createDataFrame([(wave,), ([-1.0, 0.0, -1.0, 0.0],), ([0.0, -1.0],)], "w array<double>")
    w = F.col("w")
    rows = df.select(wf.width_at_half_trough(w), wf.width_at_half_peak(w), wf.peak_to_trough(w), wf.pre_peak_half_width(w), wf.is_thin(w, 8 + 5, 1.0)).collect()
    # under -4 at places 6 to 8; at 2 and more at 11 to 13; the peak before is four samples earlier, at 1.25 and more at 2 and 3
    assert tuple(rows[0]) == (3, 3, 4, 2, True)
    assert tuple(rows[1])[:2] == (None, None) and rows[2][2] == 1


def test_phases_along_arrays(spark):
    h = np.cumsum(np.random.default_rng(3).uniform(-3, 3, 30))
    df = spark.createDataFrame([((h % (2 * np.pi)).tolist(),)], "h array<double>")
    steps, centred = df.select(wf.phase_steps(F.col("h")), wf.centred_steps(wf.phase_steps(F.col("h")))).first()
    assert np.allclose(steps, np.diff(h)) and np.allclose(centred, np.gradient(h))
    z = np.exp(0.7j)
    re, im = spark.createDataFrame([(float(z.real), float(z.imag))], "re double, im double").select(*wf.rotated(F.col("re"), F.col("im"), 50.0)).first()
    assert re + 1j * im == pytest.approx(z * np.exp(2j * np.pi * 0.05))
