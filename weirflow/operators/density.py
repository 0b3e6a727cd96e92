"""Densities: kernel and nearest-neighbour estimates, modes, mixtures, products of Gaussians."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def kde(df: DataFrame, x: str, grid: Sequence[float], by: str, cells: int = 512) -> DataFrame:
    """(by, at, density) Gaussian kernel density on a stated grid, bandwidth n^(-1/5) sd.

    Values are first counted in cells of a fine grid over their range, so the kernel sum's cost does not
    grow with the rows; a cell is range / `cells` wide."""
    w = F.when(F.col(x).isNotNull(), F.col(x))
    stats = df.groupBy(by).agg(F.count(w).alias("_n"), F.stddev_samp(w).alias("_sd"), F.min(w).alias("_low"), F.max(w).alias("_high")).where("_sd > 0")
    step = (F.col("_high") - F.col("_low")) / cells
    at = F.least(F.floor((F.col(x) - F.col("_low")) / step), F.lit(cells - 1))
    counted = df.join(stats, by).groupBy(by, at.alias("_cell")).agg(F.count(w).alias("_k"), F.avg(w).alias("_x")).where("_k > 0").join(stats, by)
    h = F.col("_sd") * F.pow("_n", -0.2)
    spread = counted.select(by, "_k", "_n", "_x", h.alias("_h"), F.explode(F.array(*(F.lit(float(g)) for g in grid))).alias("at"))
    z = (F.col("at") - F.col("_x")) / F.col("_h")
    return spread.groupBy(by, "at").agg((F.sum(F.col("_k") * F.exp(-0.5 * z * z)) / F.first(F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def mode(density: DataFrame, by: str) -> DataFrame:
    """Grid point of the highest density, the smallest on ties."""
    return density.groupBy(by).agg(F.max_by("at", F.struct("density", -F.col("at"))).alias("mode"))


def knn_density(df: DataFrame, x: str, by: str, tie: str, k: int = 10) -> DataFrame:
    """Density at each value: 2 k neighbours over the width they span, fewer at the ends."""
    order = Window.partitionBy(by).orderBy(x, tie)
    frame = order.rowsBetween(-k, k)
    n = F.count("*").over(Window.partitionBy(by))
    width = F.max(x).over(frame) - F.min(x).over(frame)
    return df.withColumn("density", (F.count("*").over(frame) - 1) / F.nullif(width, F.lit(0.0)) / n)


def hard_mixture(df: DataFrame, x: str, k: int, rounds: int = 20, tolerance: float = 1e-6) -> list[tuple[float, float, float]]:
    """(mean, deviation, share) of k Gaussians fitted by hard reassignment from equal shares in order of
    value. Each round is one aggregate."""
    cuts = df.agg(F.percentile(x, F.array(*(F.lit(j / k) for j in range(1, k))))).first()[0] if k > 1 else []
    if cuts is None:
        return []
    group: Column = F.lit(0)
    for c in cuts:
        group = group + (F.col(x) > c).cast("int")
    found: list[tuple[float, float, float]] = []
    for _ in range(rounds):
        rows = df.where(F.col(x).isNotNull()).groupBy(group.alias("_g")).agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.count("*").alias("n")).orderBy("m").collect()
        n = sum(r.n for r in rows)
        now = [(r.m, max(r.s, 1e-9), r.n / n) for r in rows]
        if len(now) == len(found) and all(abs(a - b) <= tolerance * (1 + abs(b)) for p, q in zip(now, found, strict=True) for a, b in zip(p, q, strict=True)):
            break
        found = now
        score = [F.lit(math.log(p) - math.log(s)) - 0.5 * F.pow((F.col(x) - m) / s, 2) for m, s, p in now]
        best = F.greatest(*score) if len(score) > 1 else score[0]
        group = F.lit(0)
        for j, s in reversed(list(enumerate(score))):
            group = F.when(s == best, F.lit(j)).otherwise(group)
    return found


def gaussian_product(m1: Column, t1: Column, m2: Column, t2: Column) -> tuple[Column, Column]:
    """Mean and precision of the product of two densities given by mean and precision."""
    t = t1 + t2
    return (m1 * t1 + m2 * t2) / t, t


def gaussian_quotient(m1: Column, t1: Column, m2: Column, t2: Column) -> tuple[Column, Column]:
    t = t1 - t2
    return (m1 * t1 - m2 * t2) / t, t


def gaussian_dkl(m1: Column, t1: Column, m2: Column, t2: Column) -> Column:
    """Divergence of the second from the first."""
    return 0.5 * (t2 / t1 - 1 - F.log(t2 / t1) + t2 * F.pow(m1 - m2, 2))


def fuse(df: DataFrame, m: str, t: str, by: Sequence[str]) -> DataFrame:
    """Product of a group's densities: (mean, precision)."""
    return df.groupBy(*by).agg((F.sum(F.col(m) * F.col(t)) / F.sum(t)).alias("mean"), F.sum(t).alias("precision"))
