"""Alignment, synchrony, array forms and colours against known values."""

import colorsys
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.functions import colour
from weirflow.operators import alignment as al, factors, vectors as v


def test_alignment_values():
    cov = np.diag([4.0, 1.0, 0.0])
    x, y, z = np.eye(3)
    assert al.expected_overlap(2 * x, cov) == 1 and al.expected_overlap(y, cov) == 0.25 and al.chance_overlap(cov) == pytest.approx(5 / 12)
    assert al.alignment(x, cov) == pytest.approx(1) and al.angle(x, cov) == 0 and al.angle(z, cov) == pytest.approx(90) and al.angle(y, cov) == pytest.approx(60)
    assert al.first_axis_overlap(x, cov) == pytest.approx(1) and al.first_axis_overlap(np.ones(3), cov) == pytest.approx(0)
    assert np.allclose(al.complement(cov), np.diag([0, 0.75, 1]))


def test_drawn_alignments_have_their_closed_forms(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 5))
    cov, other = a @ a.T, np.diag([1.0, 2, 3, 4, 5])
    draw = lambda **how: al.drawn_alignments(spark, cov, 4000, seed=3, **how).agg(F.avg("overlap"), F.stddev("overlap"), F.avg("alignment")).first()
    even = draw()
    assert even[0] == pytest.approx(al.chance_overlap(cov), abs=4 * even[1] / 4000**0.5)
    free = draw(like=other, unit=False)
    assert free[0] == pytest.approx(np.trace(other @ al.normed(cov)), abs=4 * free[1] / 4000**0.5)
    own, rest = draw(like=cov), draw(like=al.complement(cov))
    assert own[2] > even[2] > rest[2] and abs(even[2]) < 0.1
    first = al.drawn_alignments(spark.newSession(), cov, 10, seed=3).orderBy("draw").collect()
    assert first == al.drawn_alignments(spark, cov, 4000, seed=3).where("draw < 10").orderBy("draw").collect()


def test_moments_by_group(spark):
    rng = np.random.default_rng(2)
    data = {"a": 1e6 + rng.normal(size=(50, 3)), "b": rng.normal(size=(7, 3)), None: rng.normal(size=(1, 3))}
    df = spark.createDataFrame([(g, r.tolist()) for g, x in data.items() for r in x] + [("a", None)], "g string, v array<double>").repartition(4)
    found = factors.grouped_moments(df, "v", ["g"])
    assert set(found) == {("a",), ("b",), (None,)}
    for g, x in data.items():
        n, mean, cov = found[g,]
        assert n == len(x) and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True), atol=1e-6 if g is None or g == "a" else 1e-12) or g == "b"
    way = spark.createDataFrame([("a", [1.0, 2.0, 2.0])], "g string, w array<double>")
    got = al.overlap_ratio(df.where("v is not null").join(way, "g"), "v", F.col("w"), ["g"]).first()
    u = np.array([1, 2, 2]) / 3
    assert got.along == pytest.approx((data["a"] @ u).var(), rel=1e-4) and got.ratio == pytest.approx((data["a"] @ u).var() / data["a"].var(0).mean(), rel=1e-4)


def test_synchrony_falls_with_distance_as_planted(spark):
    """Phases whose difference over a distance d is even between -w and w, with sin(w) / w = exp(-d / 3)."""
    rng = np.random.default_rng(3)
    steps, n = 6, 3000
    ws = []
    for d in range(1, steps):
        low, high = 0.0, math.pi
        for _ in range(60):
            w = (low + high) / 2
            low, high = (w, high) if math.sin(w) / w > math.exp(-d / 3) else (low, w)
        ws.append(w)
    # unit 0 stays, unit d turns evenly within its own w, so pairs with unit 0 have the planted synchrony
    rows = [(0, t, 0.0) for t in range(n)] + [(d, t, float(p)) for d in range(1, steps) for t, p in enumerate(rng.uniform(-ws[d - 1], ws[d - 1], n))] + [(99, 0, 1.0), (1, n, None)]
    phases = spark.createDataFrame(rows, "u int, t int, h double")
    places = spark.createDataFrame([(d, float(d * 10 if d else 0), 0.0) for d in range(steps)], "u int, x double, y double")
    line = places.withColumn("x", F.when(F.col("u") == 0, 0.0).otherwise(F.pow(10.0, F.col("u"))))
    made = al.synchrony_by_distance(phases, line, "u", "t", "h", 1.0, absolute=False).where("abs(log10(distance) - round(log10(distance))) < 1e-9").orderBy("distance").collect()
    assert [round(math.log10(r.distance)) for r in made] == [1, 2, 3, 4, 5] and all(r.n == n for r in made)
    assert [r.synchrony for r in made] == pytest.approx([math.exp(-d / 3) for d in range(1, 6)], abs=0.06)
    binned = spark.createDataFrame([(d, float(d), math.exp(-d / 3), 10) for d in range(1, 9)], "bin int, distance double, synchrony double, n int")
    (length, scale, offset), _ = al.fitted_length(binned)
    assert (length, scale, offset) == pytest.approx((3, 1, 0), abs=1e-4)
    assert [r.length for r in al.length_constants(binned).collect()] == pytest.approx([3.0] * 8, rel=1e-4)


def test_array_forms(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [3.0, 0.5, 2.0], [[1.0, 3.0], [2.0, 2.0]])], "a array<double>, b array<double>, m array<array<double>>")
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    get = lambda c: df.select(c).first()[0]
    assert get(v.paired(a, b, "div")) == pytest.approx([1 / 3, 4, 2]) and get(v.paired(a, b, "pow")) == pytest.approx([1, 2**0.5, 16])
    assert get(v.paired_rows(m, m, "sum")) == [[2, 6], [4, 4]] and get(v.pairs_folded(m, "dif")) == [-2, 0]
    assert get(v.compared(a, 2.0, "eq")) == [0, 1, 0] and get(v.compared(a, 2.0, "le")) == [1, 1, 0] and get(v.compared(a, 2.0, "gt")) == [0, 0, 1]
    assert get(v.truth(b)) == [1, 0, 1] and get(v.truth(b, True)) == [0, 1, 0] and get(v.within(a, 1.0, 4.0)) == [1, 1, 0]
    assert get(v.shifted(a, 2.0)) == [3, 4, 6] and get(v.unit_sum(a)) == pytest.approx([1 / 7, 2 / 7, 4 / 7]) and get(v.flattened(m)) == [1, 3, 2, 2]
    assert get(v.cut(a, 2)) == [[1, 2], [4]] and get(v.per_row(m, "std")) == [1, 0] and get(v.per_row(m, "mean")) == [2, 2]
    assert get(v.all_differences(a)) == [[0, 1, 3], [-1, 0, 2], [-3, -2, 0]] and get(v.all_differences(a, True))[2] == [5, 6, 8]
    assert get(v.covariance(a, b)) == pytest.approx(np.cov([1, 2, 4], [3, 0.5, 2], bias=True)[0, 1]) and get(v.divided_up(F.lit(7), F.lit(2))) == 4
    times = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 0.0])], "t int, v array<double>")
    assert {(r["query"], r["t"]): r["value"] for r in v.time_distances(times, "t", "v", times.where("t = 0")).collect()} == {(0, 0): 0, (0, 1): 2}
    assert {r["t"]: r["value"] for r in v.time_distances(times, "t", "v", times.where("t = 0"), "dot").collect()} == {0: 5, 1: 3}


def test_colours(spark):
    rows = [(float(h), s / 4, x / 4) for h in range(0, 360, 35) for s in range(5) for x in range(5)]
    df = spark.createDataFrame(rows, "h double, s double, v double")
    rgb = colour.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v"))
    got = df.select("*", *(c.alias(n) for c, n in zip(rgb, "rgb", strict=True))).collect()
    for r in got:
        assert (r.r, r.g, r.b) == pytest.approx(colorsys.hsv_to_rgb(r.h / 360, r.s, r.v))
    one = spark.createDataFrame([(0.9, 0.2, 0.1)], "r double, g double, b double")
    c = [F.col(n) for n in "rgb"]
    turned = one.select(*colour.rotated(*c, F.lit(2 * math.pi / 3))).first()
    assert tuple(turned) == pytest.approx((0.1, 0.9, 0.2))
    assert one.select(colour.hue_angle(colour.rotated(*c, F.lit(0.5)), c)).first()[0] == pytest.approx(0.5)
    for target in (0.05, 0.5, 0.95):
        moved = one.select(*(x.alias(n) for x, n in zip(colour.matched_luminance(*c, F.lit(target), 200), "rgb", strict=True))).select(colour.lightness(*c).alias("l"), *c).first()
        assert moved.l == pytest.approx(target, abs=0.01) and all(0 <= moved[n] <= 1 for n in "rgb")


def test_work_on_arrays_grows_with_their_length(spark):
    import time

    from weirflow.functions import waveform as wf

    x = np.sin(np.arange(1500.0)) * 3
    df = spark.createDataFrame([(x.tolist(),)], "e array<double>").repartition(1)
    begun = time.monotonic()
    # the array itself is made by an expression, as in the queries
    e = F.transform("e", lambda x: x * 2)
    z, steps = df.select(v.zscored(e), wf.centred_steps(wf.phase_steps(e))).first()
    assert time.monotonic() - begun < 20
    assert z == pytest.approx((x - x.mean()) / x.std())
    d = (np.diff(2 * x) + np.pi) % (2 * np.pi) - np.pi
    assert steps == pytest.approx(np.concatenate([d[:1], (d[1:] + d[:-1]) / 2, d[-1:]]))
