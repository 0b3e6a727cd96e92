"""Corrections for many tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def _ranked(df: DataFrame, p: str, by: str) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col(p).asc_nulls_last())
    rows = df.withColumn("_n", F.count(p).over(Window.partitionBy(by)))
    # ties take their highest rank: the smallest adjusted value among them is theirs in any case
    return rows.withColumn("_rank", F.sum(F.when(F.col(p).isNotNull(), 1)).over(order.rangeBetween(Window.unboundedPreceding, 0)))


def benjamini_hochberg(df: DataFrame, p: str, by: str, alpha: float = 0.05) -> DataFrame:
    """Add p_adjusted and rejected within each family `by`; null p-values stay null and don't count."""
    rows = _ranked(df, p, by).withColumn("_raw", F.col(p) * F.col("_n") / F.col("_rank"))
    down = Window.partitionBy(by).orderBy(F.col(p).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)
    adjusted = F.when(F.col(p).isNotNull(), F.least(F.min("_raw").over(down), F.lit(1.0)))
    return rows.withColumn("p_adjusted", adjusted).withColumn("rejected", F.col("p_adjusted") <= alpha).drop("_n", "_rank", "_raw")


def thresholds(df: DataFrame, p: str, by: str, alpha: float = 0.05) -> DataFrame:
    """(by, p_independent, p_any): the largest p at or under alpha k / n, and with n's harmonic sum."""
    rows = _ranked(df, p, by).where(F.col(p).isNotNull())
    harmonic = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("_n")), F.lit(0.0), lambda s, k: s + 1.0 / k)
    families = rows.groupBy(by).agg(F.max("_n").alias("_n")).select(by, harmonic.alias("_h"))
    line = alpha * F.col("_rank") / F.col("_n")
    best = lambda bound: F.max(F.when(F.col(p) <= bound, F.col(p)))
    return rows.join(families, by).groupBy(by).agg(best(line).alias("p_independent"), best(line / F.col("_h")).alias("p_any"))


def two_stage(df: DataFrame, p: str, by: str, alpha: float = 0.05) -> DataFrame:
    """Two-stage step-up: a first pass at alpha / (1 + alpha) estimates the true nulls for the second."""
    first = benjamini_hochberg(df, p, by, alpha / (1 + alpha)).drop("p_adjusted")
    w = Window.partitionBy(by)
    n, r = F.count(p).over(w), F.sum(F.col("rejected").cast("int")).over(w)
    rows = first.withColumn("_true", n - r).withColumn("_all", n).drop("rejected")
    second = benjamini_hochberg(rows, p, by, alpha)
    scaled = F.least(F.col("p_adjusted") * F.col("_true") / F.col("_all") * (1 + alpha), F.lit(1.0))
    return second.withColumn("p_adjusted", scaled).withColumn("rejected", F.col("p_adjusted") <= alpha).drop("_true", "_all")


def cauchy_combine(p: Column) -> Column:
    """One p-value of many, by the mean of their Cauchy scores."""
    return 0.5 - F.atan(F.avg(F.tan((0.5 - p) * math.pi))) / math.pi


def two_tailed(delta: Column) -> Column:
    """p-value of resampled differences by their sign; null below 100 of them."""
    low = F.avg(F.when(delta < 0, 1.0).when(delta == 0, 0.5).otherwise(0.0))
    return F.when(F.count(delta) >= 100, F.least(F.lit(1.0), 2 * F.least(low, 1 - low)))
