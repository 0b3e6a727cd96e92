"""Samples of zero: quotients, logarithms and directions as SQL has them."""

import math

import pytest
from pyspark.sql import functions as F

from weirflow.operators import normalize as n, polar, population as pop
from weirflow.queries import QUERIES


@pytest.mark.parametrize(("column", "want"), [
    (lambda: n.absunitscale("x", "g", minor=True), {0: math.nan, 1: math.inf, 2: 1.0, 3: -3.0, 4: None, 5: math.nan, 6: 1.0}),
    (lambda: n.absunitscale("x", "g"), {0: 0.0, 1: 1.0, 2: 1.0 / 3, 3: -1.0, 4: None, 5: math.nan, 6: 1.0}),
    (lambda: n.unitsum("x", "g"), {0: 0.0, 1: 1.0, 2: -0.5, 3: 1.5, 4: None, 5: math.nan, 6: 1.0}),
    (lambda: n.unitlength("x", "g"), {0: 0.0, 1: 1.0, 2: 0.1**0.5, 3: -(0.9**0.5), 4: None, 5: math.nan, 6: 1.0}),
    (lambda: n.deltaovermean("x", "g"), {0: -1.0, 1: 1.0, 2: -2.0, 3: 2.0, 4: None, 5: math.nan, 6: 0.0}),
])
def test_quotients_by_zero(spark, column, want):
    rows = [(0, "a", 0.0), (1, "a", 5.0), (2, "b", 1.0), (3, "b", -3.0), (4, "b", None), (5, "c", 0.0), (6, "d", 2.0)]
    got = {r.k: r.y for r in spark.createDataFrame(rows, "k int, g string, x double").select("k", column().alias("y")).collect()}
    for k, w in want.items():
        assert got[k] is None if w is None else got[k] == pytest.approx(w, nan_ok=True)


def _samples(spark):
    rows = [("a", 3.0, 0.0), ("a", 0.0, 1.0), ("a", 2.0, 2.0), ("b", 1.0, 0.5), ("b", 2.0, 0.7)]
    return spark.createDataFrame(rows, "g string, v double, a double").withColumns({"re": F.col("v") * F.cos("a"), "im": F.col("v") * F.sin("a")})


def _by_group(df):
    return {r.g: r for r in df.collect()}


def test_zero_samples_count_where_asked(spark):
    got = _by_group(polar.complex_gaussian(_samples(spark), "re", "im", ["g"], zeros=True))
    assert got["a"].x == pytest.approx((3 + 2 * math.cos(2)) / 3)
    assert _by_group(polar.complex_gaussian(_samples(spark), "re", "im", ["g"]))["a"].x == pytest.approx((3 + 2 * math.cos(2)) / 2)


def test_log_polar_gaussian_with_zeros(spark):
    got = _by_group(polar.log_polar_gaussian(_samples(spark), "re", "im", ["g"], zeros=True))
    assert all(math.isnan(got["a"][c]) for c in ("log_amplitude", "major", "minor", "tilt")) and not math.isnan(got["a"].turn)
    assert got["b"] == _by_group(polar.log_polar_gaussian(_samples(spark), "re", "im", ["g"]))["b"]


def test_log_polar_statistics_with_zeros(spark):
    got = _by_group(polar.log_polar_statistics(_samples(spark), "re", "im", ["g"], zeros=True, angle="a"))
    assert got["a"].log_mean == -math.inf and all(math.isnan(got["a"][c]) for c in ("log_std", "low", "high"))
    assert got["a"].phase == pytest.approx(math.atan2(math.sin(1) + math.sin(2), 1 + math.cos(1) + math.cos(2)))
    assert got["b"].log_mean == pytest.approx(math.log(2) / 2)


def test_signed_polar_statistics_with_zeros(spark):
    got = _by_group(polar.signed_polar_statistics(_samples(spark), "re", "im", ["g"], zeros=True))
    assert math.isnan(got["a"].axis_std) and not math.isnan(got["b"].axis_std)
    assert abs(got["a"]["mean"]) == pytest.approx((3 - 2) / 3)


def test_population_with_zeros(spark):
    got = _by_group(pop.description(_samples(spark), "re", "im", ["g"], size="v", directed=True))
    assert math.isnan(got["a"].kuramoto) and got["a"].amplitude == pytest.approx(5 / 3) and not math.isnan(got["b"].kuramoto)
    assert not math.isnan(_by_group(pop.description(_samples(spark), "re", "im", ["g"]))["a"].kuramoto)


def test_zero_logarithm_in_scalar_functions(spark, tmp_path):
    """The query keeps arguments above 1e-300, as its SQL does."""
    spark.createDataFrame([(1, 0.0), (2, 100.0)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.slog for r in QUERIES["scalar_functions"](spark, str(tmp_path)).collect()}
    assert got == {1: -690.775528, 2: 0.0}
