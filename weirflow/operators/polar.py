"""Distributions of complex samples by group: normal, log-polar, signed polar and von Mises, from moments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import quotient
from ..plans.joins import same_join


def _rows(df: DataFrame, re: str, im: str, by: Sequence[str], zeros: bool = False, angle: str | None = None) -> DataFrame:
    """Samples (_r, _i), their size _a and direction (_c, _s): NaN for a zero, unless a column gives angles.

    Zeros stay only where they are asked for; they then count, and take the logarithm of no amplitude as minus infinity."""
    r, i = F.col(re).cast("double"), F.col(im).cast("double")
    size = F.sqrt(r * r + i * i)
    way = (F.cos(angle), F.sin(angle)) if angle else (quotient(r, size), quotient(i, size))
    used = r.isNotNull() & i.isNotNull()
    return df.where(used if zeros else used & ((r != 0) | (i != 0))).select(*by, r.alias("_r"), i.alias("_i"), size.alias("_a"), way[0].alias("_c"), way[1].alias("_s"))


def _log(x: Column) -> Column:
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def _spread(k: Column) -> Column:
    """Circular deviation of a resultant; of NaN, NaN."""
    return F.when(F.isnan(k), k).when(k > 0, F.sqrt(-2 * F.log(F.least(k, F.lit(1.0)))))


def _axes(xx: Column, xy: Column, yy: Column) -> dict[str, Column]:
    """Deviations along the two axes of a covariance, and the first one's angle."""
    middle, half = (xx + yy) / 2, F.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    return {"major": F.sqrt(F.greatest(middle + half, F.lit(0.0))), "minor": F.sqrt(F.greatest(middle - half, F.lit(0.0))), "tilt": 0.5 * F.atan2(2 * xy, xx - yy)}


def complex_gaussian(df: DataFrame, re: str, im: str, by: Sequence[str] = (), zeros: bool = False) -> DataFrame:
    """(by, x, y, major, minor, tilt): centre and axes of one deviation of the samples. Nulls are left out, and zeros unless `zeros`."""
    made = _rows(df, re, im, by, zeros).groupBy(*by).agg(F.avg("_r").alias("x"), F.avg("_i").alias("y"), F.var_samp("_r").alias("xx"), F.covar_samp("_r", "_i").alias("xy"), F.var_samp("_i").alias("yy"))
    return made.withColumns(_axes(F.col("xx"), F.col("xy"), F.col("yy"))).drop("xx", "xy", "yy")


def log_polar_gaussian(df: DataFrame, re: str, im: str, by: Sequence[str] = (), zeros: bool = False) -> DataFrame:
    """(by, phase, log_amplitude, turn, major, minor, tilt): axes of log amplitude and a quarter of the phase about that of
    the mean, samples weighing as their amplitude does. With `zeros` those stay: a group that has one has no log amplitude (NaN)."""
    rows = _rows(df, re, im, by, zeros)
    centre = rows.groupBy(*by).agg(F.atan2(F.avg("_i"), F.avg("_r")).alias("phase"))
    rows = same_join(rows, centre, list(by)) if by else rows.withColumn("phase", F.lit(centre.first()[0]))
    turn = F.atan2(F.sin(F.atan2("_i", "_r") - F.col("phase")), F.cos(F.atan2("_i", "_r") - F.col("phase"))) / 4
    rows = rows.withColumns({"_x": _log(F.col("_a")), "_y": turn})
    w = F.col("_a")
    made = rows.groupBy(*by, "phase").agg(F.sum(w).alias("w"), F.sum(w * w).alias("ww"), *(F.sum(w * e).alias(n) for n, e in {"x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") ** 2, "xy": F.col("_x") * F.col("_y"), "yy": F.col("_y") ** 2}.items()))
    mean = lambda c: F.col(c) / F.col("w")
    # weights adding up to one, and the bias of that
    bias = 1 / F.nullif(1 - F.col("ww") / (F.col("w") * F.col("w")), F.lit(0.0))
    cov = lambda c, a, b: (mean(c) - mean(a) * mean(b)) * bias
    return made.select(*by, "phase", mean("x").alias("log_amplitude"), mean("y").alias("turn"), *(v.alias(k) for k, v in _axes(cov("xx", "x", "x"), cov("xy", "x", "y"), cov("yy", "y", "y")).items()))


def log_polar_statistics(df: DataFrame, re: str, im: str, by: Sequence[str] = (), zeros: bool = False, angle: str | None = None) -> DataFrame:
    """(by, phase, phase_std, log_mean, log_std, low, high): a log-polar ellipse's centre, arc and radial line. With
    `zeros` those stay, in the direction that `angle` gives; a group that has one has a log_mean of minus infinity, and NaN for what follows."""
    made = _rows(df, re, im, by, zeros, angle).groupBy(*by).agg(
        F.atan2(F.avg("_s"), F.avg("_c")).alias("phase"), quotient(F.sqrt(F.avg("_r") ** 2 + F.avg("_i") ** 2), F.avg("_a")).alias("_k"), F.avg(_log(F.col("_a"))).alias("log_mean"), F.stddev_pop(_log(F.col("_a"))).alias("log_std"),
    )
    return made.select(*by, "phase", _spread(F.col("_k")).alias("phase_std"), "log_mean", "log_std", F.exp(F.col("log_mean") - F.col("log_std")).alias("low"), F.exp(F.col("log_mean") + F.col("log_std")).alias("high"))


def signed_polar_statistics(df: DataFrame, re: str, im: str, by: Sequence[str] = (), zeros: bool = False) -> DataFrame:
    """(by, axis, axis_std, mean, std): samples along an axis and its reverse: the angle of the mean square halved,
    amplitudes with the sign of their side of it, and the angles' deviation with the reverse side turned over.
    With `zeros` those stay: they count in mean and std, and the deviation of angles, of which they have none, is NaN."""
    rows = _rows(df, re, im, by, zeros)
    axis = rows.groupBy(*by).agg((F.atan2(F.avg(2 * F.col("_r") * F.col("_i")), F.avg(F.col("_r") ** 2 - F.col("_i") ** 2)) / 2).alias("axis"))
    rows = same_join(rows, axis, list(by)) if by else rows.withColumn("axis", F.lit(axis.first()[0]))
    side = F.signum(F.col("_r") * F.cos("axis") + F.col("_i") * F.sin("axis"))
    rows = rows.withColumn("_f", F.when(side == 0, 1.0).otherwise(side))
    length = F.sqrt(F.avg(F.col("_c") * F.col("_f")) ** 2 + F.avg(F.col("_s") * F.col("_f")) ** 2)
    made = rows.groupBy(*by, "axis").agg(length.alias("_k"), F.avg(F.col("_a") * F.col("_f")).alias("mean"), F.stddev_pop(F.col("_a") * F.col("_f")).alias("std"))
    return made.select(*by, "axis", _spread(F.col("_k")).alias("axis_std"), "mean", "std")


def von_mises(df: DataFrame, angle: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, location, concentration): from the first circular moment, by the usual three approximations of its inverse."""
    made = df.where(F.col(angle).isNotNull()).groupBy(*by).agg(F.avg(F.cos(angle)).alias("_c"), F.avg(F.sin(angle)).alias("_s"))
    r = F.sqrt(F.col("_c") ** 2 + F.col("_s") ** 2)
    k = F.when(r < 0.53, 2 * r + r**3 + 5 * r**5 / 6).when(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r)).otherwise(1 / F.nullif(r**3 - 4 * r**2 + 3 * r, F.lit(0.0)))
    return made.select(*by, F.atan2("_s", "_c").alias("location"), k.alias("concentration"))


def ellipse(x: Column, y: Column, major: Column, minor: Column, tilt: Column, n: int = 100) -> Column:
    """Points (x, y) of a contour of one deviation, as an array."""
    turns = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * (2 * math.pi / (n - 1)))
    return F.transform(turns, lambda t: F.struct((x + major * F.cos(t) * F.cos(tilt) - minor * F.sin(t) * F.sin(tilt)).alias("x"), (y + major * F.cos(t) * F.sin(tilt) + minor * F.sin(t) * F.cos(tilt)).alias("y")))


def mean_cosine(a: Column, b: Column) -> Column:
    """Agreement of two angles, as an aggregate."""
    return F.avg(F.cos(a - b))
