"""Histograms and statistics by bins of another variable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.joins import spine


def uniform_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin from 0; the last one holds its right end; null outside."""
    at = F.floor((x - low) * bins / (high - low)).cast("long")
    return F.when((x >= low) & (x <= high), F.least(at, F.lit(bins - 1)))


def clamped_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """As uniform_bin, values outside in the outermost bins."""
    at = F.floor((x - low) * bins / (high - low)).cast("long")
    return F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int, clamp: bool = False) -> DataFrame:
    """(bin, n, share) with empty bins."""
    at = (clamped_bin if clamp else uniform_bin)(F.col(x), low, high, bins)
    counts = spine(df.where(F.col(x).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).where("bin is not null"), "bin", 0, bins, {"n": 0})
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", F.col("n") / total)


def grid_histogram(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Counts of (floor(x / width), floor(y / width))."""
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    return df.groupBy(cell(y).alias("row"), cell(x).alias("col")).agg(F.count("*").alias("n"))


def bilinear_histogram(df: DataFrame, x: str, y: str, n: int, weight: Column | None = None) -> DataFrame:
    """(row, col, total): points of the unit square shared out to the four nearest cells of an n by n grid.

    The shares of a point sum to its weight, so totals sum to that of the points."""
    at = lambda c: F.greatest(F.lit(0.0), F.least(F.col(c) * (n - 1), F.lit(n - 1 - 1e-9)))
    w = F.lit(1.0) if weight is None else weight
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(at(x).alias("_x"), at(y).alias("_y"), w.alias("_w"))
    ix, iy = F.floor("_x").cast("long"), F.floor("_y").cast("long")
    fx, fy = F.col("_x") - ix, F.col("_y") - iy
    corners = [F.struct((iy + a).alias("row"), (ix + b).alias("col"), (F.col("_w") * (fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("s")) for a in (0, 1) for b in (0, 1)]
    return rows.select(F.explode(F.array(*corners)).alias("c")).groupBy("c.row", "c.col").agg(F.sum("c.s").alias("total"))


def binned_stats(df: DataFrame, at: Column, y: str) -> DataFrame:
    """Mean, median, deviation, count, standard error and 5-95 % range of y by bin."""
    made = df.groupBy(at.alias("bin")).agg(F.avg(y).alias("mean"), F.median(y).alias("median"), F.stddev_pop(y).alias("sd"), F.count(y).alias("n"), F.percentile(y, F.array(F.lit(0.05), F.lit(0.95))).alias("_p"))
    return made.where("bin is not null").select("bin", "mean", "median", "sd", "n", (F.col("sd") / F.sqrt("n")).alias("sem"), F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def percentile_edges(df: DataFrame, x: str, bins: int) -> list[float]:
    """bins + 1 percentile edges of x, from one aggregate."""
    return list(df.agg(F.percentile(x, F.array(*(F.lit(k / bins) for k in range(bins + 1))))).first()[0] or [])


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """Bin of edges, each closed on the left and the last one on both sides; null outside."""
    out = F.when(x == edges[-1], F.lit(len(edges) - 2).cast("long"))
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = out.when((x >= a) & (x < b), F.lit(k).cast("long"))
    return out


def pike(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Statistics of y in bins of x that hold as many rows each, by percentile edges."""
    edges = percentile_edges(df, x, bins)
    return binned_stats(df, edge_bin(F.col(x), edges), y) if edges else binned_stats(df, F.lit(None).cast("long"), y)


def trendline(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
