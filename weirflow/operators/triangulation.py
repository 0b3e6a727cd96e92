"""Delaunay triangulations of point sets of any size: adjacency, triangles and unique edges.

Points are dealt to the leaves of a tree of quartered cells, so crowds have small cells. A cell triangulates its points and
keeps the triangles whose circle lies in it. A point that is surrounded by such triangles alone is done; all others go on to
the cell above together with the points of the triangles that they have, which keep their surroundings as they are. So a cell
gets what its parts leave at their rims, about the root of its points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.joins import same_join
from ..plans.store import checkpoint_folder

#: Points up to which a cell is not parted, and the deepest level of cells: a side is halved so many times.
PER_TILE, DEPTH = 64, 16


def circles(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of the circles through triangles of points; infinite where the points are in line."""
    a, b, c = (p[t[:, k]] for k in range(3))
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    bb, cc = (b**2).sum(axis=1), (c**2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d], axis=1)
    u = np.where(np.isfinite(u), u, np.inf)
    return a + u, (u**2).sum(axis=1)


def triangulated(p: np.ndarray) -> np.ndarray:
    """Triangles of (n, 2) distinct points as rows of three numbers, by adding one point after another.

    Each new point takes away the triangles whose circle holds it, and is joined to the edges of the hole. A triangle far
    around all points is begun with, and what touches it is taken away in the end."""
    n = len(p)
    if n < 3:
        return np.zeros((0, 3), int)
    centre, size = p.mean(axis=0), max(np.ptp(p, axis=0).max(), 1e-300)
    q = np.vstack([(p - centre) / size, [[-3e4, -3e4], [3e4, -3e4], [0, 3e4]]])
    tri = np.array([[n, n + 1, n + 2]])
    middle, square = circles(q, tri)
    for k in np.lexsort((p[:, 1], p[:, 0])):
        inside = ((middle - q[k]) ** 2).sum(axis=1) < square
        gone = tri[inside]
        sides = np.sort(np.concatenate([gone[:, [0, 1]], gone[:, [1, 2]], gone[:, [2, 0]]]), axis=1)
        sides, times = np.unique(sides, axis=0, return_counts=True)
        sides = sides[times == 1]
        fresh = np.column_stack([sides, np.full(len(sides), k)])
        m, s = circles(q, fresh)
        flat = ~np.isfinite(s)
        s[flat] = np.inf
        m[flat] = 0.0
        tri, middle, square = np.vstack([tri[~inside], fresh]), np.vstack([middle[~inside], m]), np.concatenate([square[~inside], s])
    return np.sort(tri[(tri < n).all(axis=1)], axis=1)


def _cells(points: DataFrame, per_tile: int) -> DataFrame:
    """Points (s, k, x, y) with their set's corner, the deepest cells' widths, their own deepest cell and their leaf's level."""
    ends = points.groupBy("s").agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("a", F.min), ("z", F.max))))
    ends = ends.select("s", "ax", "ay", *((F.greatest(F.col(f"z{c}") - F.col(f"a{c}"), F.lit(1e-300)) / (1 << DEPTH)).alias(f"w{c}") for c in "xy"))
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"a{c}")) / F.col(f"w{c}")).cast("long"), F.lit((1 << DEPTH) - 1))
    rows = same_join(points, ends, ["s"]).withColumns({"cx": at("x"), "cy": at("y")}).checkpoint()
    above = rows.select("s", "k", "cx", "cy", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1))).alias("level"))
    up = F.expr(f"cast(shiftleft(1L, {DEPTH} - level) as long)")
    above = above.select("s", "k", "level", *(F.floor(F.col(f"c{c}") / up).cast("long").alias(f"u{c}") for c in "xy"))
    full = above.groupBy("s", "level", "ux", "uy").count().where(F.col("count") > per_tile).drop("count")
    leaf = same_join(above, full, ["s", "level", "ux", "uy"]).groupBy("s", "k").agg((F.max("level") + 1).alias("level"))
    return same_join(rows, leaf.withColumnsRenamed({"level": "_level"}), ["s", "k"], "left").withColumn("level", F.coalesce("_level", F.lit(0))).drop("_level")


def _cell(level: int):
    """Of a cell's points: its triangles that no part of it has given, and the points that go on to the cell above."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")  # so that a triangle has the same circle in all cells
        p, names, open_ = group[["x", "y"]].to_numpy(), group["k"].to_numpy(), group["open"].to_numpy(bool)
        corner, width = group[["ax", "ay"]].to_numpy()[0], group[["wx", "wy"]].to_numpy()[0]
        t = triangulated(p)
        t = t[open_[t].any(axis=1)]
        centre, square = circles(p, t)
        r = np.sqrt(square)[:, None]

        def within(deep: int) -> np.ndarray:
            """Does a circle lie in one cell of a level? Beyond the set's bounds there is no point, so outer cells have no end there."""
            cell = width * 2.0 ** (DEPTH - deep)
            with np.errstate(invalid="ignore"):
                low, high = (np.clip(np.floor((v - corner) / cell), 0, 2**deep - 1) for v in (centre - r, centre + r))
            return (low == high).all(axis=1) & np.isfinite(square)

        final = within(level)
        fresh = final & ~within(level + 1) if group["level"].max() > level else final
        sides, times = np.unique(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [0, 2]]]), axis=0, return_counts=True)
        done = np.zeros(len(p), bool)
        done[t] = True
        done[sides[times == 1]] = False
        done[t[~final]] = False
        still = open_ & ~done
        keep = still.copy()
        keep[t[final & still[t].any(axis=1)]] = True
        made, rest = names[t[fresh]].reshape(-1, 3), group[keep & (level > 0)]
        n, m = len(made), len(rest)
        columns = {"s": pd.Series([key[0]] * (n + m), dtype=object), "triangle": np.arange(n + m) < n}
        for at, (c, own) in enumerate((("a", "k"), ("b", "cx"), ("c", "cy"))):
            columns[c] = np.concatenate([made[:, at], rest[own]]).astype(np.int64)
        columns |= {c: np.concatenate([np.zeros(n), rest[c]]) for c in ("x", "y", "ax", "ay", "wx", "wy")}
        return pd.DataFrame(columns | {"level": np.concatenate([np.zeros(n, np.int32), rest["level"]]).astype(np.int32), "open": np.concatenate([np.zeros(n, bool), still[keep & (level > 0)]])})

    return run


def delaunay(points: DataFrame, by: str, key: str, x: str = "x", y: str = "y", per_tile: int = PER_TILE) -> DataFrame:
    """(by, a, b, c): triangles of each set's points by their whole-number keys, a < b < c.

    Keys are unique within a set. Points at one place are one, of the smallest key; rows with a null are left out. Sets of
    under three points, or in line, have none; of four or more points on a circle some triangulation may be missing
    or twice. Points on a set's hull meet in one task, all points if they are in line."""
    checkpoint_folder(points.sparkSession)
    rows = points.select(F.col(by).alias("s"), F.col(key).cast("long").alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    rows = _cells(rows.groupBy("s", "x", "y").agg(F.min("k").alias("k")), per_tile).withColumn("open", F.lit(True)).checkpoint()
    columns = ("s", "k", "x", "y", "ax", "ay", "wx", "wy", "cx", "cy", "level", "open")
    shown = f"s {dict(rows.dtypes)['s']}, triangle boolean, a long, b long, c long, x double, y double, ax double, ay double, wx double, wy double, level int, open boolean"
    found = rest = None
    deepest, n = rows.agg(F.max("level"), F.count(F.lit(1))).first()
    # a row is much work, so few bytes of them must not end up in one task
    parts = max(2 * points.sparkSession.sparkContext.defaultParallelism, n // 20_000)
    for level in range(deepest or 0, -1, -1):
        here = rows.where(F.col("level") == level).select(*columns)
        here = here if rest is None else here.unionByName(rest)
        cell = {f"u{c}": F.shiftright(f"c{c}", DEPTH - level) for c in "xy"}
        made = here.withColumns(cell).repartition(parts, "s", "ux", "uy").groupBy("s", "ux", "uy").applyInPandas(_cell(level), shown).checkpoint()
        rest = made.where("not triangle").select("s", F.col("a").alias("k"), "x", "y", "ax", "ay", "wx", "wy", F.col("b").alias("cx"), F.col("c").alias("cy"), "level", "open")
        done = made.where("triangle").select("s", "a", "b", "c")
        found = done if found is None else found.unionByName(done)
    return found.withColumnRenamed("s", by)


def edges(triangles: DataFrame, by: str) -> DataFrame:
    """(by, p, q, n): each side of the triangles once, p < q, and how many triangles it has."""
    sides = triangles.select(by, F.explode(F.array(*(F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))))).alias("e"))
    return sides.groupBy(by, F.col("e.p").alias("p"), F.col("e.q").alias("q")).agg(F.count(F.lit(1)).alias("n"))


def neighbours(triangles: DataFrame, by: str) -> DataFrame:
    """(by, k, near): the points that each one shares a side with, in order."""
    both = edges(triangles, by).select(by, F.col("p").alias("k"), F.col("q").alias("o"))
    both = both.unionByName(both.select(by, F.col("o").alias("k"), F.col("k").alias("o")))
    return both.groupBy(by, "k").agg(F.sort_array(F.collect_list("o")).alias("near"))
