"""Recursions along series in small batches, against whole-series kernels and integration on a fine grid."""

import numpy as np
import pandas as pd
import pytest

from weirflow.functions import state as st
from weirflow.operators import scan, windows


@pytest.fixture(autouse=True)
def small_batches(spark):
    """Batches cut every series in several places."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def frame(spark, data, kind="double"):
    return spark.createDataFrame([(s, i, v, f"{s}{i}") for s, x in data.items() for i, v in enumerate(x)], f"s string, i long, x {kind}, note string").repartition(3)


def series(df, name, column):
    return [r[column] for r in df.where(df.s.eqNullSafe(name)).orderBy("i").collect()]


COUNTS = {"a": [0.0, 1.0, 5.0, 7.0, 6.0, 0.0, 0.0, 1.0, 0.0, 4.0, 5.0, 0.0] * 4, "b": [3.0], None: [0.0, 6.0] * 9}
MOVE, START, RATES = np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.3, 0.7]), np.array([0.5, 4.0])


def loglike(x):
    return st.poisson_loglike(x, RATES)


def test_averages_never_forget(spark):
    """An impulse at the start is still there 150 samples later; nulls change nothing; other columns pass."""
    df = frame(spark, {"a": [1000.0] + [0.0] * 150, "b": [None, 2.0, None, 4.0], "none": [None]})
    made = windows.ema(df, "x", "s", "i", 0.999, "y")
    assert made.columns == [*df.columns, "y"]
    assert series(made, "a", "y")[150] == pytest.approx(1000 * 0.999**150)
    assert series(made, "b", "y")[1:] == pytest.approx([2.0, 2.0, 2.002])
    assert series(made, "b", "y")[0] is None and series(made, "none", "y") == [None] and series(made, "b", "note") == ["b0", "b1", "b2", "b3"]


def test_paths_and_posteriors(spark):
    df = frame(spark, COUNTS)
    path = scan.viterbi(df, "s", "i", "x", loglike, MOVE, START)
    said = scan.posteriors(df, "s", "i", "x", loglike, MOVE, START)
    for s, x in COUNTS.items():
        x = np.array(x)
        assert series(path, s, "state") == st.viterbi(loglike(x), MOVE, START).tolist()
        posterior, total = st.forward_backward(loglike(x), MOVE, START)
        assert np.allclose(series(said, s, "posterior"), posterior) and sum(series(said, s, "gain")) == pytest.approx(total)


def test_kalman(spark):
    rng = np.random.default_rng(1)
    data = {s: np.cumsum(rng.normal(size=n)).tolist() for s, n in (("a", 40), ("b", 1), ("c", 9))}
    data["a"][13] = None
    a, b, q, r = np.array([[1.0, 1.0], [0.0, 0.9]]), np.array([[1.0, 0.0]]), np.diag([0.1, 0.2]), np.array([[0.5]])
    got = scan.kalman(frame(spark, data), "s", "i", ["x"], a, b, q, r, np.zeros(2), np.eye(2))
    for s, y in data.items():
        m, c = st.kalman_smooth(np.array(y, float)[:, None], a, b, q, r, np.zeros(2), np.eye(2))
        assert np.allclose(series(got, s, "mean"), m) and np.allclose(np.array(series(got, s, "cov")).reshape(-1, 2, 2), c)


def test_linear_filter(spark):
    a, c = np.array([[-0.2, 0.1], [0.0, -0.5]]), np.array([1.0, 0.5])
    data = {"a": np.arange(30.0).tolist(), "b": [1.0, None, 2.0]}
    got = scan.linear_filter(frame(spark, data), "s", "i", "x", a, c, np.ones(2))
    for s, x in data.items():
        assert np.allclose(series(got, s, "z"), st.linear_filter(a, c, np.nan_to_num(np.array(x, float)), np.ones(2)))


@pytest.mark.parametrize("kind", sorted(scan.OBSERVED))
def test_moments_equal_fine_integration(kind):
    like = scan.OBSERVED[kind]
    for y in (0, 1, 2, 30) if kind not in ("logistic", "truncated") else (0, 1):
        for m, v in ((0.0, 1.0), (2.0, 0.01), (-1.0, 25.0), (4.0, 400.0)):
            x = np.linspace(m - 8 * v**0.5, m + 8 * v**0.5, 400_001)
            logs = like(y, x, 0.8, 0.3) - 0.5 * (x - m) ** 2 / v
            p = np.exp(logs - logs.max())
            mean = p @ x / p.sum()
            got = scan.moments(lambda z, y=y: like(y, z, 0.8, 0.3), m, v)
            assert got[0] == pytest.approx(mean, abs=2e-3 * v**0.5) and got[1] == pytest.approx(p @ (x - mean) ** 2 / p.sum(), rel=2e-2)
            assert got[2] == pytest.approx(np.log(p.sum() * (x[1] - x[0])) + logs.max() - 0.5 * np.log(2 * np.pi * v), abs=1e-2)


@pytest.mark.parametrize(("y", "bias", "room"), [([0.0, 1.0, 3.0, None, 2.0, 9.0, 7.0, 0.0, 1.0, 0.0, 4.0, 2.0], 0.0, 0.35), ([22.0, 31.0, 30.0, None, 41.0, 38.0, 55.0, 61.0, 40.0], 3.0, 0.05)])
def test_hidden_rates_against_a_grid(spark, y, bias, room):
    """Beliefs of a drifting log rate against exact integration, forwards and backwards: near for large counts, within a
    third of a deviation for counts near zero that jump, where no normal belief is exact."""
    walk = scan.Walk(0.95, 0.1, 0.5, 0.0, 1.0)
    df = frame(spark, {"a": y, "b": [2.0]})
    ahead = scan.density_filter(df, "s", "i", "x", walk, bias=bias)
    both = scan.density_smoother(df, "s", "i", "x", walk, bias=bias)
    x = np.linspace(-6, 6, 1201)
    move = np.exp(-0.5 * (x[None] - (0.5 + 0.95 * (x[:, None] - 0.5))) ** 2 / 0.1)
    move /= move.sum(1, keepdims=True)
    logs = [np.zeros_like(x) if v is None else v * x - np.exp(x + bias) for v in y]
    like = [np.exp(v - v.max()) for v in logs]
    f, now = [], np.exp(-0.5 * x**2)
    for n, p in enumerate(like):
        now = (now if n == 0 else now @ move) * p
        now /= now.sum()
        f.append(now)
    back, post = np.ones_like(x), [None] * len(y)
    for n in range(len(y) - 1, -1, -1):
        post[n] = f[n] * back / (f[n] @ back)
        back = move @ (back * like[n])
        back /= back.sum()
    for made, exact in (([v[0] for v in series(ahead, "a", "fm")], f), (series(both, "a", "mean"), post)):
        means = np.array([p @ x for p in exact])
        sd = np.sqrt([p @ x**2 - (p @ x) ** 2 for p in exact])
        assert (np.abs(np.array(made) - means) < room * sd).all()
    assert series(both, "b", "mean") == pytest.approx([v[0] for v in series(ahead, "b", "fm")])


def test_peaks_of_several_hidden_values(spark):
    rng = np.random.default_rng(2)
    b = np.array([1.0, -0.5])
    for y in (0, 1, 40):
        c = np.array([[1.0, 0.3], [0.3, 0.5]])
        m, got = scan.laplace_poisson(np.array([0.2, -0.1]), c, b, y)
        cost = lambda x, y=y, c=c: np.exp(b @ x) - y * (b @ x) + 0.5 * (x - [0.2, -0.1]) @ np.linalg.solve(c, x - [0.2, -0.1])
        assert all(cost(m) <= cost(m + d) + 1e-12 for d in 0.1 * rng.normal(size=(50, 2)))
        assert np.allclose(np.linalg.inv(got), np.linalg.inv(c) + np.outer(b, b) * np.exp(b @ m))
    one = scan.laplace_smoother(frame(spark, {"a": [1.0, 4.0, None, 2.0]}), "s", "i", "x", np.eye(1), 0.1 * np.eye(1), np.ones(1), np.zeros(1), np.eye(1))
    assert len(series(one, "a", "mean")) == 4 and all(v[0] > 0 for v in series(one, "a", "cov"))


def test_series_side_by_side_go_on_over_batches(spark):
    def step(state, got, fresh):
        now = np.where(fresh, 0.0, state[0]) + got["x"]
        return {"sum": now, "both": np.stack([now, got["x"]], axis=1)}, (now,)

    rng = np.random.default_rng(5)
    data = pd.DataFrame({"s": np.repeat(["a", "b", "c", "d"], [1, 40, 3, 17]), "x": rng.integers(0, 9, 61).astype(float)})
    data["i"] = data.groupby("s").cumcount()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for reverse in (False, True):
            got = scan.together(spark.createDataFrame(data).repartition(3), "s", "i", ["x"], lambda n: (np.zeros(n),), step, "sum double, both array<double>", reverse=reverse).toPandas().sort_values(["s", "i"])
            want = (data.iloc[::-1] if reverse else data).groupby("s")["x"].cumsum().sort_index()
            assert got["sum"].tolist() == want.tolist() and [list(b) for b in got["both"]] == [list(b) for b in zip(want, data["x"])]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_moments_of_many_are_those_of_each():
    m, v, y = np.array([0.2, -3.0, 1.0]), np.array([0.5, 4.0, 1e-4]), np.array([0.0, 3.0, 7.0])
    like = scan.OBSERVED["log"]
    many = scan.all_moments(lambda x, which: like(y[which, None], x, 1.0, 0.0), m, v)
    for k in range(3):
        assert scan.moments(lambda x, k=k: like(y[k], x, 1.0, 0.0), m[k], v[k]) == pytest.approx([a[k] for a in many], rel=1e-12)
