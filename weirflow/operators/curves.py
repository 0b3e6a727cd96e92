"""Curves through points: cubic splines with bootstrap bands, robust lines, and non-linear models.

Every fit reads sums only. A spline's basis functions are columns, and one aggregate gives the normal equations of
all bootstrap replicates. Robust lines and non-linear models go in rounds of one aggregate each, at the parameters so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import grouped, uniforms
from ..plans.joins import replicates
from .quantiles import exact_quantiles, uniform, unit_bounds


@dataclass(frozen=True)
class Spline:
    """Cubic pieces between `knots`, straight beyond them if `natural`. Coordinates run from 0 to 1 between the ends."""

    knots: tuple[float, ...]
    natural: bool = True

    @property
    def size(self) -> int:
        return len(self.knots) if self.natural else len(self.knots) + 2

    def _scaled(self) -> list[float]:
        low, high = self.knots[0], self.knots[-1]
        return [(k - low) / (high - low) for k in self.knots]

    def _terms(self, u, cube: Callable) -> list:
        """Basis functions at u, for columns or arrays alike; `cube` is the third power of what is positive."""
        at = self._scaled()
        if not self.natural:
            return [u * 0 + 1, u, u * u, u * u * u] + [cube(u - k) for k in at[1:-1]]
        d = [(cube(u - k) - cube(u - at[-1])) / (at[-1] - k) for k in at[:-1]]
        return [u * 0 + 1, u] + [x - d[-1] for x in d[:-1]]

    def columns(self, x: Column) -> list[Column]:
        u = (x.cast("double") - F.lit(self.knots[0])) / F.lit(self.knots[-1] - self.knots[0])
        return self._terms(u, lambda c: F.when(c > 0, c * c * c).otherwise(F.lit(0.0)))

    def values(self, x: np.ndarray) -> np.ndarray:
        """(points, functions)."""
        u = (np.asarray(x, float) - self.knots[0]) / (self.knots[-1] - self.knots[0])
        return np.stack([np.broadcast_to(t, u.shape) for t in self._terms(u, lambda c: np.where(c > 0, c, 0.0) ** 3)], axis=-1)


def spline_knots(df: DataFrame, x: str, df_: int = 5, natural: bool = True) -> Spline:
    """A spline of `df_` degrees of freedom beside the mean, its knots at even quantiles of the distinct values."""
    n = df_ + 1 if natural else df_ - 1
    if n < 2:
        raise ValueError("too few degrees of freedom")
    made = exact_quantiles(df.select(x).distinct(), x, [k / (n - 1) for k in range(n)]).orderBy("p").collect()
    knots = tuple(sorted({r["value"] for r in made}))
    if len(knots) < 2:
        raise ValueError("there is one value, or none")
    return Spline(knots, natural)


def replicate_grams(df: DataFrame, basis: Sequence[Column], y: str, key: str, n: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """(by, replicate, g<i>_<j>, c<i>, yy, n): normal equations of the data (replicate -1) and of `n` Poisson bootstraps.

    Draws and sums are made batch by batch: one row for each replicate, group and batch is shuffled."""
    rows = df.select(*by, F.col(y).cast("double").alias("_y"), F.col(key).alias("_key"), *(b.alias(f"_b{i}") for i, b in enumerate(basis))).dropna(subset=["_y", *(f"_b{i}" for i in range(len(basis)))])
    m = len(basis)
    names = [*(f"g{i}_{j}" for i in range(m) for j in range(i, m)), *(f"c{i}" for i in range(m)), "yy", "n"]
    kinds = dict(rows.dtypes)
    shown = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "replicate int", *(f"{c} double" for c in names)])
    sums = rows.withColumns({"_key": F.col("_key").cast("string"), **{f"_b{i}": F.col(f"_b{i}").cast("double") for i in range(m)}}).mapInArrow(_gram_sums(m, n, seed, tuple(by), names), shown)
    return sums.groupBy(*by, "replicate").agg(*(F.sum(c).alias(c) for c in names))


def _gram_sums(m: int, n: int, seed: int, by: tuple[str, ...], names: list[str]):
    """Batches of (by, _y, _key, _b0, ...) to sums for each group and replicate: weights times products, once a batch."""
    bounds = unit_bounds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("_y").to_numpy()
            b = [batch.column(f"_b{i}").to_numpy() for i in range(m)]
            cells = np.stack([*(b[i] * b[j] for i in range(m) for j in range(i, m)), *(v * y for v in b), y * y, np.ones(len(y))], axis=1)
            w = np.stack([np.ones(len(y)), *(np.searchsorted(bounds, u, "right") for u in uniforms(seed, batch.column("_key"), range(n)))])
            codes, first = grouped(batch, by)
            sums = np.stack([w[:, codes == g] @ cells[codes == g] for g in range(len(first))])
            at = np.repeat(np.arange(len(first)), n + 1)
            columns = [*(batch.column(c).take(first).take(pa.array(at)) for c in by), pa.array(np.tile(np.arange(-1, n, dtype=np.int32), len(first)))]
            # a replicate in which no row of the group is drawn has no sums
            drawn = sums[:, :, -1].ravel() > 0
            columns += [pa.array(np.ascontiguousarray(sums[:, :, k].ravel())) for k in range(cells.shape[1])]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(drawn)) for c in columns], [*by, "replicate", *names])

    return run


def solved(r, size: int, reg: float) -> np.ndarray:
    """Ridge weights of a row of `replicate_grams`; the ridge is relative to the functions' mean square."""
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
    c = np.array([r[f"c{i}"] for i in range(size)])
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    g = g / np.outer(scale, scale)
    return np.linalg.lstsq(g + reg * np.eye(size), c / scale, rcond=1e-13)[0] / scale


def spline_regression(df: DataFrame, x: str, y: str, key: str, at: Sequence[float], df_: int = 5, n: int = 1000, reg: float = 1e-15, confidence: float = 0.95, natural: bool = True, seed: int = 0) -> DataFrame:
    """(x, fit, low, median, high): a cubic spline of y on x at the points `at`, with its bootstrap band.

    Knots are the data's in every replicate. What reaches the driver is one small system for each replicate."""
    spline = spline_knots(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, df_, natural)
    grams = replicate_grams(df, spline.columns(F.col(x)), y, key, n, seed).collect()
    if not grams:
        raise ValueError("there is no point")
    b = spline.values(np.array(at, float))
    curves = {r["replicate"]: b @ solved(r, spline.size, reg) for r in grams}
    drawn = np.array([c for r, c in curves.items() if r >= 0]) if n else b[:0, 0].reshape(0, len(b))
    tail = (1 - confidence) / 2
    band = np.quantile(drawn, [tail, 0.5, 1 - tail], axis=0) if len(drawn) else np.full((3, len(b)), np.nan)
    return df.sparkSession.createDataFrame([tuple(map(float, r)) for r in zip(at, curves[-1], *band, strict=True)], "x double, fit double, low double, median double, high double")


def robust_line(df: DataFrame, x: str, y: str, perpendicular: bool = True, rounds: int = 30, tolerance: float = 1e-6) -> tuple[float, float]:
    """(slope, intercept) of the line of least summed distance, perpendicular or vertical.

    Points are weighed anew by one over their distance, from the line of least squares on; each round is one aggregate
    of weighted moments. Perpendicular distances may have several least sums; the one reached from there is given."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    mx, my, sx, sy = rows.agg(F.avg("x"), F.avg("y"), F.stddev_pop("x"), F.stddev_pop("y")).first()
    if not sx:
        raise ValueError("x does not vary")
    rows = rows.select((F.col("x") - mx).alias("x"), (F.col("y") - my).alias("y"))
    slope = shift = None
    before = np.inf
    tiny = 1e-9 * (sx + sy)
    for _ in range(rounds):
        d = F.lit(1.0) if slope is None else F.abs(F.col("y") - slope * F.col("x") - shift) / (np.hypot(slope, 1) if perpendicular else 1.0)
        w = F.lit(1.0) if slope is None else 1 / F.greatest(d, F.lit(tiny))
        s = rows.agg(*(F.sum(e).alias(n) for n, e in {"w": w, "a": w * F.col("x"), "b": w * F.col("y"), "aa": w * F.col("x") ** 2, "ab": w * F.col("x") * F.col("y"), "bb": w * F.col("y") ** 2, "d": d}.items())).first()
        a, b = s["a"] / s["w"], s["b"] / s["w"]
        xx, xy, yy = s["aa"] / s["w"] - a * a, s["ab"] / s["w"] - a * b, s["bb"] / s["w"] - b * b
        if slope is not None and before - s["d"] <= tolerance * s["d"]:
            break
        before = s["d"] if slope is not None else np.inf
        new = np.tan(0.5 * np.arctan2(2 * xy, xx - yy)) if perpendicular and slope is not None else xy / xx
        slope, shift = float(new), float(b - new * a)
    return slope, shift + my - slope * mx


def nonlinear_fit(df: DataFrame, model: Callable[[list[Column]], Column], y: str, start: Sequence[float], weight: str | None = None, rounds: int = 100, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Parameters that minimise the weighted squared error of `model`, and that error, by damped Gauss-Newton steps.

    `model` makes a column of parameter columns. A round is one aggregate: error, gradient and curvature from central
    differences at the parameters so far, together with the error at the next step tried."""
    p = np.array(start, float)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    at = lambda q: model([F.lit(float(v)) for v in q])
    m = len(p)

    def moments(q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        h = 1e-6 * np.maximum(np.abs(q), 1e-3)
        made = [((at(q + h[i] * np.eye(m)[i]) - at(q - h[i] * np.eye(m)[i])) / (2 * h[i])).alias(f"j{i}") for i in range(m)]
        rows = df.select((F.col(y).cast("double") - at(q)).alias("r"), w.alias("w"), *made).where("r is not null and not isnan(r) and w is not null")
        got = rows.agg(F.sum(F.col("w") * F.col("r") ** 2), *(F.sum(F.col("w") * F.col("r") * F.col(f"j{i}")) for i in range(m)), *(F.sum(F.col("w") * F.col(f"j{i}") * F.col(f"j{k}")) for i in range(m) for k in range(i, m))).first()
        if got[0] is None:
            raise ValueError("there is no point")
        g, upper, curve = np.array(got[1 : m + 1]), iter(got[m + 1 :]), np.zeros((m, m))
        for i in range(m):
            for k in range(i, m):
                curve[i, k] = curve[k, i] = next(upper)
        return float(got[0]), g, curve

    error, g, curve = moments(p)
    damping = 1e-3
    for _ in range(rounds):
        step = np.linalg.lstsq(curve + damping * np.diag(np.diag(curve) + 1e-300), g, rcond=None)[0]
        tried = moments(p + step)
        if np.isfinite(tried[0]) and np.isfinite(tried[1]).all() and tried[0] <= error:
            done = error - tried[0] <= tolerance * max(error, 1e-300) and np.all(np.abs(step) <= 1e-8 * (np.abs(p) + 1e-8))
            p, damping = p + step, max(damping / 10, 1e-12)
            error, g, curve = tried
            if done or error == 0:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return p, error


def exponential_decay(df: DataFrame, x: str, y: str, start: Sequence[float] = (1, 1, 0), weight: str | None = None) -> tuple[np.ndarray, float]:
    """(length, scale, offset) of scale exp(-x / length) + offset."""
    return nonlinear_fit(df, lambda p: p[1] * F.exp(F.least(F.lit(50.0), -F.col(x) / p[0])) + p[2], y, start, weight)


def damped_cosine(df: DataFrame, x: str, y: str, start: Sequence[float] = (1, 1, 0), weight: str | None = None) -> tuple[np.ndarray, float]:
    """(frequency, length, log scale) of cos(frequency x) exp(-x / length + log scale)."""
    return nonlinear_fit(df, lambda p: F.cos(p[0] * F.col(x)) * F.exp(F.least(F.lit(50.0), p[2] - F.col(x) / p[1])), y, start, weight)


def gaussian_bump(df: DataFrame, x: str, y: str, start: Sequence[float] = (0, 1, 1, 0), weight: str | None = None) -> tuple[np.ndarray, float]:
    """(mean, deviation, scale, offset) of scale times a normal density plus an offset."""
    density = lambda p: F.exp(-0.5 * ((F.col(x) - p[0]) / p[1]) ** 2) / (F.abs(p[1]) * float(np.sqrt(2 * np.pi)))
    return nonlinear_fit(df, lambda p: p[2] * density(p) + p[3], y, start, weight)


def half_gaussian(df: DataFrame, x: str, y: str, start: Sequence[float] = (1, 1, 0), weight: str | None = None) -> tuple[np.ndarray, float]:
    """(deviation, scale, offset) of a bump about zero."""
    density = lambda p: F.exp(-0.5 * (F.col(x) / p[0]) ** 2) / (F.abs(p[0]) * float(np.sqrt(2 * np.pi)))
    return nonlinear_fit(df, lambda p: p[1] * density(p) + p[2], y, start, weight)


def circular_regression(df: DataFrame, theta: str, y: str, key: str, by: Sequence[str] = (), n: int = 1000, shuffles: int = 1000, confidence: float = 0.95, seed: int = 0) -> list[dict]:
    """y on cosine, sine and 1 for each group, with bootstrap intervals and a p-value.

    a, b, c are the weights, d = hypot(a, b) the depth, theta the peak's angle, r2 the share explained. d_low and the
    like bound `confidence` of the bootstrap; angles are about the peak. The p-value is that of a depth at least as
    large when every row's angle is drawn evenly: (as large + 1) / (shuffles + 1)."""
    angle = F.col(theta).cast("double")
    found: dict[tuple, dict] = {}
    for r in replicate_grams(df, [F.cos(angle), F.sin(angle), F.lit(1.0)], y, key, n, seed, by).collect():
        w = solved(r, 3, 1e-12)
        var = r["yy"] / r["n"] - (r["c2"] / r["n"]) ** 2
        left = (r["yy"] - w @ np.array([r["c0"], r["c1"], r["c2"]])) / r["n"]
        found.setdefault(tuple(r[c] for c in by), {})[r["replicate"]] = (w, np.hypot(w[0], w[1]), np.arctan2(w[1], w[0]), 1 - left / var if var > 0 else np.nan)
    # the null: angles drawn anew for each row and replicate
    rows = df.select(*by, F.col(y).cast("double").alias("_y"), F.col(key).alias("_key")).where(F.col(theta).isNotNull() & F.col("_y").isNotNull())
    rows = replicates(rows, shuffles).withColumn("_t", uniform(seed + 1, "_key", "replicate") * float(2 * np.pi))
    basis = {"_b0": F.cos("_t"), "_b1": F.sin("_t"), "_b2": F.lit(1.0)}
    m = range(3)
    null = rows.withColumns(basis).groupBy(*by, "replicate").agg(*(F.sum(F.col(f"_b{i}") * F.col(f"_b{j}")).alias(f"g{i}_{j}") for i in m for j in m if i <= j), *(F.sum(F.col(f"_b{i}") * F.col("_y")).alias(f"c{i}") for i in m))
    further: dict[tuple, int] = {}
    for r in null.collect():
        k = tuple(r[c] for c in by)
        w = solved(r, 3, 1e-12)
        further[k] = further.get(k, 0) + bool(np.hypot(w[0], w[1]) >= found[k][-1][1])
    tail, out = (1 - confidence) / 2, []
    for k, made in sorted(found.items(), key=lambda x: str(x[0])):
        w, d, peak, r2 = made[-1]
        drawn = np.array([(v[1], (v[2] - peak + np.pi) % (2 * np.pi) - np.pi, v[3]) for r, v in made.items() if r >= 0]).reshape(-1, 3)
        low, high = np.quantile(drawn, [tail, 1 - tail], axis=0) if len(drawn) else np.full((2, 3), np.nan)
        out.append(dict(zip(by, k, strict=True)) | {"a": w[0], "b": w[1], "c": w[2], "d": d, "d_low": low[0], "d_high": high[0], "theta": peak, "theta_low": low[1], "theta_high": high[1], "r2": r2, "r2_low": low[2], "r2_high": high[2], "p_value": (further.get(k, 0) + 1) / (shuffles + 1)})
    return out
