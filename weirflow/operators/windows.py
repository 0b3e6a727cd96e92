"""Sliding, block and neighbour operators over series (`by`, order column `i`, value `x`)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _order(by: str, i: str):
    return Window.partitionBy(by).orderBy(i)


def centred(by: str, i: str, n: int):
    """Frame [i - n // 2, i + n - n // 2), cut at the ends of the series."""
    return _order(by, i).rowsBetween(-(n // 2), n - n // 2 - 1)


def percentile_filter(x: str, by: str, i: str, share: float, n: int = 100) -> Column:
    return F.percentile(x, F.lit(share)).over(centred(by, i, n))


def median_filter(x: str, by: str, i: str, n: int = 100) -> Column:
    return percentile_filter(x, by, i, 0.5, n)


def variance_filter(x: str, by: str, i: str, n: int = 100) -> Column:
    return F.var_pop(x).over(centred(by, i, n))


def mirrored(df: DataFrame, x: str, by: str, i: str, pad: int, mode: str = "reflect") -> DataFrame:
    """The series with `pad` samples more at each end: reflected without the end, or clamped to it.

    A series of n samples is padded by n - 1 reflected samples at most."""
    if mode not in ("reflect", "clamp"):
        raise ValueError("mode is reflect or clamp")
    size = Window.partitionBy(by)
    rows = df.select(by, i, x, F.max(i).over(size).alias("_last"))
    near = F.sequence(F.lit(0), F.lit(pad))
    if mode == "reflect":
        places = F.filter(F.array(F.col(i), -F.col(i), 2 * F.col("_last") - F.col(i)), lambda p: (p >= -pad) & (p <= F.col("_last") + pad))
    else:
        low = F.when(F.col(i) == 0, F.transform(near, lambda k: -k.cast("long"))).otherwise(F.array())
        high = F.when(F.col(i) == F.col("_last"), F.transform(near, lambda k: F.col("_last") + k)).otherwise(F.array())
        places = F.concat(F.array(i), low, high)
    return rows.select(by, F.explode(F.array_distinct(places)).alias(i), x, "_last")


def box_filter(df: DataFrame, x: str, by: str, i: str, n: int, to: str, mode: str = "reflect") -> DataFrame:
    """Moving average of n samples over the padded series, at the samples themselves."""
    padded = mirrored(df, x, by, i, n, mode).withColumn(to, F.avg(x).over(centred(by, i, n)))
    return padded.where((F.col(i) >= 0) & (F.col(i) <= F.col("_last"))).select(by, i, x, to)


def gaussian_taps(sigma: float) -> list[float]:
    """Normalised taps of half width ceil(2 sigma)."""
    half = math.ceil(2 * sigma)
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [t / sum(taps) for t in taps]


def fir(x: str, by: str, i: str, taps: Sequence[float]) -> Column:
    """Centred weighted sum with the end samples repeated beyond the ends. `taps` are odd in number."""
    half, order = len(taps) // 2, _order(by, i)
    first = F.first(x).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(x).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = F.lit(0.0)
    for k, tap in enumerate(taps):
        d = k - half
        near = F.col(x) if d == 0 else F.coalesce(F.lag(x, -d).over(order), first) if d < 0 else F.coalesce(F.lead(x, d).over(order), last)
        out = out + F.lit(float(tap)) * near
    return out


def gaussian_smooth(x: str, by: str, i: str, sigma: float) -> Column:
    return fir(x, by, i, gaussian_taps(sigma))


def block(i: str, n: int) -> Column:
    return F.floor(F.col(i) / F.lit(n)).cast("long")


def stats_block(df: DataFrame, by: str, i: str, n: int, **stats: Column) -> DataFrame:
    """Statistics of consecutive whole blocks of n samples; a remainder is dropped."""
    made = df.groupBy(by, block(i, n).alias("block")).agg(F.count("*").alias("_n"), *(c.alias(k) for k, c in stats.items()))
    return made.where(F.col("_n") == n).drop("_n")


def central_difference(x: str, by: str, i: str, rate: float = 240.0) -> Column:
    """(x[t+1] - x[t-1]) * rate / 2, null at both ends."""
    w = _order(by, i)
    return (F.lead(x).over(w) - F.lag(x).over(w)) * F.lit(rate) / 2


def spaced_derivative(x: str, by: str, i: str) -> Column:
    """Steps resampled to the samples: the step at an end, the mean of both steps within."""
    w = _order(by, i)
    back, on = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    n, at = F.count("*").over(Window.partitionBy(by)), F.row_number().over(w) - 1
    share = at / F.nullif(n - 1, F.lit(0))
    return F.coalesce(back * share + on * (1 - share), on, back)


def lagged(x: str, by: str, i: str, lags: int = 5, space: int = 1) -> list[Column]:
    """Causal lagged copies lag_0, lag_1, ..., held at the first sample before the start."""
    w = _order(by, i)
    first = F.first(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return [(F.coalesce(F.lag(x, k * space).over(w), first) if k else F.col(x)).alias(f"lag_{k}") for k in range(lags)]


def local_maxima(x: str, by: str, i: str, endpoints: bool = False) -> Column:
    """True where the sign of the slope falls; a plateau's both ends count. Ends only if asked for."""
    w = _order(by, i)
    before, after = F.signum(F.col(x) - F.lag(x).over(w)), F.signum(F.lead(x).over(w) - F.col(x))
    inside = F.coalesce(after < before, F.lit(False))
    if not endpoints:
        return inside
    return inside | F.coalesce(before.isNull() & (after < 0), F.lit(False)) | F.coalesce(after.isNull() & (before > 0), F.lit(False))


def local_minima(x: str, by: str, i: str, endpoints: bool = False) -> Column:
    w = _order(by, i)
    before, after = F.signum(F.lag(x).over(w) - F.col(x)), F.signum(F.col(x) - F.lead(x).over(w))
    inside = F.coalesce(after < before, F.lit(False))
    if not endpoints:
        return inside
    return inside | F.coalesce(before.isNull() & (after < 0), F.lit(False)) | F.coalesce(after.isNull() & (before > 0), F.lit(False))


def quadratic_peak(df: DataFrame, x: str, by: str, i: str) -> DataFrame:
    """Sub-sample place of each series' largest value: vertex of the parabola through its neighbours."""
    w = _order(by, i)
    rows = df.select(by, F.col(i).alias("i"), F.col(x).alias("y"), F.lag(x).over(w).alias("l"), F.lead(x).over(w).alias("r"))
    best = rows.groupBy(by).agg(F.max_by(F.struct("i", "y", "l", "r"), F.struct("y", -F.col("i"))).alias("p"))
    bend = F.col("p.l") - 2 * F.col("p.y") + F.col("p.r")
    shift = F.when(bend != 0, 0.5 * (F.col("p.l") - F.col("p.r")) / bend)
    return best.select(by, F.col("p.i").alias("i"), (F.col("p.i") + F.coalesce(shift, F.lit(0.0))).alias("place"), F.col("p.y").alias("peak"))


def autocorrelation(df: DataFrame, x: str, by: str, i: str, lags: int) -> DataFrame:
    """(by, lag, r) for lags 0 to `lags`: centred products over their number, divided by that at lag 0.

    A self-join on shifted places within the series, aggregated before its shuffle."""
    rows = df.select(by, i, (F.col(x) - F.avg(x).over(Window.partitionBy(by))).alias("c"))
    there = rows.select(by, F.col(i).alias("_j"), F.col("c").alias("d"))
    pairs = rows.select(by, i, "c", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"))
    pairs = pairs.withColumn("_j", F.col(i) + F.col("lag")).join(there, [by, "_j"])
    sums = pairs.groupBy(by, "lag").agg(F.avg(F.col("c") * F.col("d")).alias("p"))
    whole = F.max(F.when(F.col("lag") == 0, F.col("p"))).over(Window.partitionBy(by))
    return sums.select(by, F.col("lag").cast("long").alias("lag"), (F.col("p") / F.nullif(whole, F.lit(0.0))).alias("r"))


def savgol_taps(half: int, degree: int, derivative: int = 0) -> list[float]:
    """Taps of a local polynomial fit over 2 half + 1 samples: value, or a derivative by sample."""
    import numpy as np

    t = np.arange(-half, half + 1, dtype=float)
    rows = np.linalg.pinv(np.vander(t, degree + 1, increasing=True))
    return (rows[derivative] * math.factorial(derivative)).tolist()


def ema(df: DataFrame, x: str, by: str, i: str, keep: float, to: str) -> DataFrame:
    """Exponential moving average started at the first sample, carried along the whole series."""
    from .scan import exponential_average

    return exponential_average(df, by, i, x, keep, to, [c for c in df.columns if c not in (by, i)]).select(*df.columns, to)
