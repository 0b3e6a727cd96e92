"""Triangulations by tiles against all empty circles of a set."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.operators import triangulation as tr


def empty_circles(p):
    """All triangles whose circle holds no point, by trying each."""
    out, t = set(), np.array(list(itertools.combinations(range(len(p)), 3)))
    for part in np.array_split(t, max(1, len(t) // 20000)):
        centre, square = tr.circles(p, part)
        free = ~(((centre[:, None] - p) ** 2).sum(axis=2) < square[:, None] * (1 - 1e-9)).any(axis=1) & np.isfinite(square)
        out |= {tuple(map(int, r)) for r in part[free]}
    return out


def valid(p, found):
    """Found triangles fill the hull exactly once and no circle holds a point."""
    t = np.array(sorted(found))
    centre, square = tr.circles(p, t)
    assert not (((centre[:, None] - p) ** 2).sum(axis=2) < square[:, None] * (1 - 1e-7)).any()
    a, b, c = (p[t[:, k]] for k in range(3))
    area = np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]).sum() / 2
    from weirflow.operators.hull import corners

    h = corners(p)
    x, y = h.T
    assert area == pytest.approx(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2, rel=1e-6)


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(1)
    return {"even": rng.random((90, 2)), "normal": rng.normal(size=(70, 2)), "clusters": np.vstack([rng.normal(size=(30, 2)) * 0.01 + c for c in ((0, 0), (5, 0.3), (2, 7))]), "three": np.array([[0.0, 0], [1, 0], [0, 1]]), "two": np.array([[0.0, 0], [1, 1]])}


def table(spark, sets):
    rows = [(s, k, float(x), float(y)) for s, p in sets.items() for k, (x, y) in enumerate(p)]
    return spark.createDataFrame([*rows, ("even", 10_000, *map(float, sets["even"][3])), ("even", 10_001, None, 1.0), ("line", 1, 0.0, 0.0), ("line", 2, 1.0, 1.0), ("line", 3, 2.0, 2.0)], "s string, k long, x double, y double").repartition(5)


@pytest.mark.parametrize("per_tile", [6, 1000])
def test_small_sets(spark, sets, per_tile):
    got = {}
    for r in tr.delaunay(table(spark, sets), "s", "k", per_tile=per_tile).collect():
        assert (r.a, r.b, r.c) not in got.setdefault(r.s, set())
        got[r.s].add((r.a, r.b, r.c))
    assert set(got) == {"even", "normal", "clusters", "three"}
    for s in got:
        assert got[s] == empty_circles(sets[s]), s
        if s != "three":
            valid(sets[s], got[s])


def test_five_hundred_points(spark):
    p = np.random.default_rng(2).random((500, 2)) * [3, 1]
    made = tr.delaunay(table(spark, {"even": p}), "s", "k", per_tile=25).where("s = 'even'")
    found = {(r.a, r.b, r.c) for r in made.collect()}
    valid(p, found)
    assert found == {tuple(map(int, r)) for r in tr.triangulated(p)}
    sides = tr.edges(made, "s").collect()
    assert len(sides) == len(found) + 500 - 1 and {r.n for r in sides} == {1, 2}
    near = {r.k: r.near for r in tr.neighbours(made, "s").collect()}
    assert len(near) == 500 and all(k in near[o] for k, own in near.items() for o in own)


def test_rows_sent_grow_with_the_points(spark):
    """Empty corners of a set make no cell see all points: a cell gets what its parts leave, and small sets of bytes many tasks."""
    sizes = []
    for n in (300, 1200):
        p = np.random.default_rng(3).normal(size=(n, 2)) ** 3
        cells = tr._cells(table(spark, {"even": p}).select("s", "k", "x", "y").dropna(), 20).where("s = 'even'")
        sizes.append(cells.groupBy("level", F.floor(F.col("cx") / F.pow(F.lit(2), tr.DEPTH - F.col("level"))), F.floor(F.col("cy") / F.pow(F.lit(2), tr.DEPTH - F.col("level")))).count().agg(F.max("count"), F.sum("count")).first())
        assert sizes[-1][0] <= 20 and sizes[-1][1] == n + 1
    found = {(r.a, r.b, r.c) for r in tr.delaunay(table(spark, {"even": p}), "s", "k", per_tile=100).where("s = 'even'").collect()}
    assert found == {tuple(map(int, r)) for r in tr.triangulated(p)}
