"""Recursive filters along series of any length, line noise, and the widths of peaks.

A filter's state is carried over sorted rows; going back over what it gave makes it free of phase. A bounded number
of samples is reflected at either end, so that the filter has settled where the series begins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.spectral import butterworth, steady
from ..plans.joins import same_join
from ..plans.store import checkpoint_folder
from .scan import together


def recursive(df: DataFrame, by: str, i: str, x: str, b: np.ndarray, a: np.ndarray, reverse: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(by, i, carry, y): a recursive filter along each series, begun as if its first value had always been; nulls hold the last one."""
    start, order = steady(b, a), len(a) - 1

    def begin(n):
        return np.zeros((n, order)), np.full(n, np.nan), np.zeros(n, bool)

    def step(state, got, fresh):
        z, last, begun = state
        v = got[x].astype(float)
        v = np.where(np.isnan(v), last, v)
        known = ~np.isnan(v)
        z = np.where(begun[:, None], z, start * v[:, None])
        y = b[0] * v + z[:, 0]
        z[known] = (np.concatenate([z[:, 1:], np.zeros((len(z), 1))], axis=1) + b[1 : order + 1] * v[:, None] - a[1:] * y[:, None])[known]
        return {"y": np.where(known, y, np.nan)}, (z, v, begun | known)

    return together(df, by, i, [x], begin, step, "y double", carry, reverse)


def reflected(df: DataFrame, by: str, i: str, x: str, n: int) -> DataFrame:
    """(by, i, x) and, before and after each series, its first and last `n` samples (all if fewer) in reverse."""
    rows = df.select(by, F.col(i).cast("long").alias(i), F.col(x).cast("double").alias(x)).where(F.col(i).isNotNull())
    ends = rows.groupBy(by).agg(F.min(i).alias("_first"), F.max(i).alias("_last"))
    rows = same_join(rows, ends, [by])
    places = F.array_compact(F.array(F.col(i), F.when(F.col(i) - F.col("_first") < n, 2 * F.col("_first") - 1 - F.col(i)), F.when(F.col("_last") - F.col(i) < n, 2 * F.col("_last") + 1 - F.col(i))))
    return rows.withColumn(i, F.explode(places)).select(by, i, x, ((F.col(i) >= F.col("_first")) & (F.col(i) <= F.col("_last"))).alias("_own"))


def bandpass(df: DataFrame, by: str, i: str, x: str, low: float | None, high: float | None, rate: float = 1000.0, order: int = 4, zero_phase: bool = True, stop: bool = False, pad: int = 256) -> DataFrame:
    """(by, i, y): Butterworth low-pass (no `low`), high-pass (no `high`), band-pass or band-stop.

    `i` numbers a series' samples without gaps. `pad` samples are reflected at either end."""
    if low is None and high is None or stop and (low is None or high is None):
        raise ValueError("give a band")
    checkpoint_folder(df.sparkSession)
    b, a = butterworth(order, low, high, rate, stop)
    rows = reflected(df, by, i, x, pad)
    made = recursive(rows, by, i, x, b, a, carry=["_own"])
    if zero_phase:
        made = recursive(made.withColumnRenamed("y", "x").checkpoint(), by, i, "x", b, a, reverse=True, carry=["_own"])
    return made.where("_own").select(by, i, "y")


def nonnegative_bandpass(df: DataFrame, by: str, i: str, x: str, low: float | None, high: float | None, rate: float = 1000.0, offset: float = 1.0, **how) -> DataFrame:
    """(by, i, y): the filter on logarithms, for values that must stay above -`offset`; y plus offset stays positive."""
    logs = df.select(by, i, F.log(F.col(x) + offset).alias("x"))
    return bandpass(logs, by, i, "x", low, high, rate, **how).withColumn("y", F.exp("y") - offset)


def without_line_noise(df: DataFrame, by: str, i: str, x: str, frequency: float = 60.0, overtones: int = 5, half_width: float = 10.0, rate: float = 1000.0, order: int = 4) -> DataFrame:
    """(by, i, y): series without the line's frequency and its multiples below half the rate."""
    made = df.select(by, i, F.col(x).alias("y"))
    for k in range(1, overtones + 1):
        low, high = k * frequency - half_width, min(k * frequency + half_width, 0.499 * rate)
        if 0 < low < high:
            made = bandpass(made.withColumnRenamed("y", "x"), by, i, "x", low, high, rate, order, stop=True)
    return made


def without_common_noise(df: DataFrame, by: str, i: str, x: str, frequency: float = 60.0, half_width: float = 5.0, rate: float = 1000.0) -> DataFrame:
    """(by, i, y): series less their projection on the mean of all of them about a frequency. Series share sample numbers."""
    band = bandpass(df, by, i, x, frequency - half_width, frequency + half_width, rate)
    noise = band.groupBy(i).agg(F.avg("y").alias("_noise")).checkpoint()
    rows = df.select(by, i, F.col(x).cast("double").alias("x")).join(noise, i)
    power = noise.agg(F.sum(F.col("_noise") * F.col("_noise"))).first()[0] or 0.0
    share = rows.groupBy(by).agg((F.sum(F.col("x") * F.col("_noise")) / F.nullif(F.lit(float(power)), F.lit(0.0))).alias("_share"))
    return same_join(rows, share, [by]).select(by, i, (F.col("x") - F.coalesce("_share", F.lit(0.0)) * F.col("_noise")).alias("y"))


def peak_widths(df: DataFrame, by: str, i: str, x: str, fraction: float = 0.5, least: float = 0.5, ends: bool = True) -> DataFrame:
    """(by, peak, height, start, stop, width): each local maximum and where it falls below `fraction` of its height.

    start and stop are the nearest lower samples, or the valleys on either side if these come first, or the series'
    ends. Maxima under `least` of the highest are left out, and those at the ends if not `ends`. Runs from valley to valley
    are worked on by themselves; equal neighbours count as no valley."""
    order = Window.partitionBy(by).orderBy(i)
    rows = df.select(by, i, F.col(x).cast("double").alias("x")).where(F.col(x).isNotNull())
    left, right = F.lag("x").over(order), F.lead("x").over(order)
    valley = (F.col("x") < F.coalesce(left, F.lit(float("inf")))) & (F.col("x") < F.coalesce(right, F.lit(float("inf")))) & left.isNotNull() & right.isNotNull()
    rows = rows.withColumns({"_v": valley.cast("int"), "_first": left.isNull(), "_last": right.isNull()})
    rows = rows.withColumn("_run", F.sum("_v").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("x", (-F.col(i)).alias("at"), "_first", "_last"))
    runs = rows.groupBy(by, "_run").agg(best.alias("m"), F.min(i).alias("_a"), F.max(i).alias("_z"))
    follows = Window.partitionBy(by).orderBy("_run")
    runs = runs.select(by, "_run", (-F.col("m.at")).alias("peak"), F.col("m.x").alias("height"), (F.col("m._first") | F.col("m._last")).alias("_end"), "_a", F.coalesce(F.lead("_a").over(follows), "_z").alias("_b"))
    inside = same_join(rows, runs, [by, "_run"])
    low = F.col("x") < fraction * F.col("height")
    made = inside.groupBy(by, "peak", "height", "_end", "_a", "_b").agg(F.max(F.when(low & (F.col(i) < F.col("peak")), F.col(i))).alias("_l"), F.min(F.when(low & (F.col(i) > F.col("peak")), F.col(i))).alias("_r"))
    tall = made.withColumn("_top", F.max("height").over(Window.partitionBy(by))).where(F.col("height") >= least * F.col("_top"))
    tall = tall if ends else tall.where("not _end")
    start, stop = F.coalesce("_l", "_a"), F.coalesce("_r", "_b")
    return tall.select(by, "peak", "height", start.alias("start"), stop.alias("stop"), (stop - start).alias("width"))


def peak_within(df: DataFrame, by: Sequence[str], frequency: str, x: str, low: float, high: float, local: bool = False) -> DataFrame:
    """(by, frequency, peak): the largest value of a band, or the largest that is above both its neighbours; ties to the
    lowest frequency. Groups without one have no row."""
    rows = df.where(F.col(x).isNotNull())
    if local:
        order = Window.partitionBy(*by).orderBy(frequency)
        rows = rows.withColumns({"_l": F.lag(x).over(order), "_r": F.lead(x).over(order)}).where((F.col(x) > F.col("_l")) & (F.col(x) > F.col("_r")))
    rows = rows.where((F.col(frequency) >= low) & (F.col(frequency) <= high))
    best = F.max(F.struct(F.col(x).alias("x"), (-F.col(frequency)).alias("f")))
    return rows.groupBy(*by).agg(best.alias("m")).select(*by, (-F.col("m.f")).alias("frequency"), F.col("m.x").alias("peak"))
