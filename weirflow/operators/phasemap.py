"""Critical points of phase maps, for many frames at once.

Every pixel posts its phase to the four cells it is a corner of, so one aggregate makes all cells. The winding number of a
cell is the sum of wrapped steps around it; a rotation's centre lies where the bilinear interpolation of the corners'
unit vectors is zero. Extrema and saddles are where the mean steps change sign between neighbouring cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.joins import same_join
from ..plans.store import checkpoint_folder
from .grid import components

CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def turn(a: Column, b: Column) -> Column:
    """The step from angle b to angle a, between -pi and pi."""
    return F.atan2(F.sin(a - b), F.cos(a - b))


def cells(grid: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """(by, row, col, p00, p01, p10, p11): cells by their upper left pixel, where all four corners have a value."""
    corner = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in CORNERS))).alias("o")
    posted = grid.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, "row", "col", F.col(value).cast("double").alias("p"), corner)
    posted = posted.select(*by, (F.col("row") - F.col("o.r")).alias("row"), (F.col("col") - F.col("o.c")).alias("col"), "o", "p")
    made = posted.groupBy(*by, "row", "col").agg(*(F.max(F.when((F.col("o.r") == r) & (F.col("o.c") == c), F.col("p"))).alias(f"p{r}{c}") for r, c in CORNERS))
    return made.dropna(subset=[f"p{r}{c}" for r, c in CORNERS])


def winding(p: DataFrame) -> DataFrame:
    """Add `winding` to cells: 1 if the phase grows by a turn going right, down, left and up, -1 if it falls, else 0."""
    path = ("p00", "p01", "p11", "p10", "p00")
    total = sum((turn(F.col(b), F.col(a)) for a, b in zip(path, path[1:], strict=False)), F.lit(0.0))
    return p.withColumn("winding", F.round(total / (2 * math.pi)).cast("int"))


def gradient(p: DataFrame) -> DataFrame:
    """Add mean wrapped steps to the next column (dx) and row (dy) to cells."""
    dx = (turn(F.col("p01"), F.col("p00")) + turn(F.col("p11"), F.col("p10"))) / 2
    dy = (turn(F.col("p10"), F.col("p00")) + turn(F.col("p11"), F.col("p01"))) / 2
    return p.withColumns({"dx": dx, "dy": dy})


def _zero() -> tuple[Column, Column]:
    """Where in a cell (along the row, down the column) the interpolated unit vectors vanish; the middle if nowhere.

    a + b u + v (c + d u) = 0 has a real v where the imaginary part of (a + b u) times the conjugate of (c + d u) is
    zero, a quadratic in u."""
    re, im = ({k: f(F.col(k)) for k in ("p00", "p01", "p10", "p11")} for f in (F.cos, F.sin))
    a = (re["p00"], im["p00"])
    b = tuple(z["p01"] - z["p00"] for z in (re, im))
    c = tuple(z["p10"] - z["p00"] for z in (re, im))
    d = tuple(z["p11"] - z["p10"] - z["p01"] + z["p00"] for z in (re, im))
    cross = lambda x, y: x[1] * y[0] - x[0] * y[1]
    k0, k1, k2 = cross(a, c), cross(a, d) + cross(b, c), cross(b, d)
    root = F.sqrt(F.greatest(k1 * k1 - 4 * k0 * k2, F.lit(0.0)))
    # the stable pair of roots; one of them alone if the equation is linear
    q = -0.5 * (k1 + F.when(k1 < 0, -root).otherwise(root))
    roots = F.array(F.when(F.abs(k2) > 1e-12, q / k2), F.when(F.abs(q) > 1e-12, k0 / q))

    def down(u: Column) -> Column:
        top, low = tuple(x + y * u for x, y in zip(a, b, strict=True)), tuple(x + y * u for x, y in zip(c, d, strict=True))
        size = low[0] * low[0] + low[1] * low[1]
        return F.when(size > 1e-24, -(top[0] * low[0] + top[1] * low[1]) / size)

    found = F.transform(roots, lambda u: F.struct(u.alias("u"), down(u).alias("v")))
    inside = F.filter(found, lambda z: (z["u"] >= -1e-9) & (z["u"] <= 1 + 1e-9) & (z["v"] >= -1e-9) & (z["v"] <= 1 + 1e-9))
    first = F.get(inside, F.lit(0))
    return F.coalesce(first["u"], F.lit(0.5)), F.coalesce(first["v"], F.lit(0.5))


def critical_points(grid: DataFrame, value: str = "value", by: Sequence[str] = (), edge: int = 0) -> DataFrame:
    """(by, kind, row, col, y, x): rotations with their centres, and maxima, minima and saddles of a phase map.

    `row` and `col` are the upper left pixel of the cell or square that holds the point, y and x its place in pixels.
    clockwise means that the phase grows going right, down, left and up. Cells with a rotation, and those next to one,
    hold no other point. Points within `edge` pixels of the frame's bounds are left out."""
    made = gradient(winding(cells(grid, value, by)))
    u, v = _zero()
    spun = made.where("winding != 0").select(*by, F.when(F.col("winding") > 0, F.lit("clockwise")).otherwise(F.lit("anticlockwise")).alias("kind"), "row", "col", (F.col("row") + v).alias("y"), (F.col("col") + u).alias("x"))
    corner = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in CORNERS))).alias("o")
    steps = made.select(*by, "row", "col", "dx", "dy", "winding", corner).select(*by, (F.col("row") - F.col("o.r")).alias("row"), (F.col("col") - F.col("o.c")).alias("col"), "o", "dx", "dy", "winding")
    at = lambda name, r, c: F.max(F.when((F.col("o.r") == r) & (F.col("o.c") == c), F.col(name)))
    squares = steps.groupBy(*by, "row", "col").agg(at("dx", 0, 0).alias("x0"), at("dx", 0, 1).alias("x1"), at("dy", 0, 0).alias("y0"), at("dy", 1, 0).alias("y1"), F.max(F.abs("winding")).alias("spun"), F.count(F.lit(1)).alias("n"))
    bend = lambda a, b: (F.signum(F.col(b)) - F.signum(F.col(a))) / 2
    squares = squares.where("n = 4 and spun = 0").select(*by, "row", "col", bend("x0", "x1").alias("bx"), bend("y0", "y1").alias("by_"))
    kind = F.when((F.col("bx") == -1) & (F.col("by_") == -1), F.lit("maximum")).when((F.col("bx") == 1) & (F.col("by_") == 1), F.lit("minimum")).when(F.col("bx") * F.col("by_") == -1, F.lit("saddle"))
    still = squares.withColumn("kind", kind).where("kind is not null").select(*by, "kind", "row", "col", (F.col("row") + 1.0).alias("y"), (F.col("col") + 1.0).alias("x"))
    out = spun.unionByName(still)
    if edge:
        names = ("_top", "_bottom", "_left", "_right")
        keyed = by or ["_frame"]
        with_frame = lambda df: df if by else df.withColumn("_frame", F.lit(0))
        bounds = with_frame(grid).groupBy(*keyed).agg(F.min("row").alias("_top"), F.max("row").alias("_bottom"), F.min("col").alias("_left"), F.max("col").alias("_right"))
        kept = F.expr(f"y - _top >= {edge} and _bottom - y >= {edge} and x - _left >= {edge} and _right - x >= {edge}")
        out = same_join(with_frame(out), bounds, keyed).where(kept).drop(*names, "_frame")
    return out


def merged(points: DataFrame, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, kind, y, x, n): points of a kind that chains of steps under `radius` connect, as their mean place.

    Pairs come from a join on squares of the radius' size; a chain's points are found by label lowering."""
    checkpoint_folder(points.sparkSession)
    keys = [*by, "kind"]
    rows = points.select(*keys, "y", "x").withColumn("_id", F.xxhash64(*keys, "y", "x")).dropDuplicates([*keys, "y", "x"]).checkpoint()
    square = lambda c: F.floor(F.col(c) / radius).cast("long")
    held = rows.withColumns({"_r": square("y"), "_c": square("x")})
    around = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1))))
    looking = held.withColumn("o", around).withColumns({"_r": F.col("_r") + F.col("o.r"), "_c": F.col("_c") + F.col("o.c")}).drop("o")
    near = same_join(looking, held.select(*keys, "_r", "_c", F.col("_id").alias("b"), F.col("y").alias("yb"), F.col("x").alias("xb")), [*keys, "_r", "_c"])
    near = near.where((F.col("_id") < F.col("b")) & (F.pow(F.col("y") - F.col("yb"), 2) + F.pow(F.col("x") - F.col("xb"), 2) < radius * radius))
    groups = components(near.select(F.col("_id").alias("a"), "b")).select(F.col("node").alias("_id"), "root")
    made = rows.join(groups, "_id", "left").withColumn("root", F.coalesce("root", "_id"))
    return made.groupBy(*keys, "root").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.count(F.lit(1)).alias("n")).drop("root")
