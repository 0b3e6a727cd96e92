"""Rank tests and tests from moments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def normal_tail(z: Column) -> Column:
    """Two-sided normal p-value, by a rational approximation of the error function to 1.2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # fixed coefficients of the Chebyshev fit
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(0.0)
    for c in reversed(terms):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def ztest(m1: Column, s1: Column, m2: Column, s2: Column) -> tuple[Column, Column]:
    """z of a difference of means with their errors, and its two-sided p."""
    z = (m1 - m2) / F.sqrt(s1 * s1 + s2 * s2)
    return z, normal_tail(z)


def mann_whitney(df: DataFrame, x: str, first: Column, by: str) -> DataFrame:
    """(by, u, z, p) of two samples in each group, with the tie correction."""
    rows = df.where(F.col(x).isNotNull()).select(by, F.col(x).alias("x"), first.alias("g"))
    tied = rows.groupBy(by, "x").agg(F.count("*").alias("t"), F.sum(F.col("g").cast("int")).alias("a"))
    before = F.sum("t").over(Window.partitionBy(by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = tied.withColumn("rank", before - (F.col("t") - 1) / 2)
    s = ranked.groupBy(by).agg(F.sum(F.col("rank") * F.col("a")).alias("r"), F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    u = F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (u - n1 * n2 / 2) / F.nullif(sd, F.lit(0.0))
    return s.select(by, u.alias("u"), z.alias("z"), normal_tail(z).alias("p"))


def wilcoxon(df: DataFrame, d: str, by: str) -> DataFrame:
    """(by, w, z, p) of signed ranks of differences, zeros left out."""
    rows = df.where(F.col(d).isNotNull() & (F.col(d) != 0)).select(by, F.abs(d).alias("x"), (F.col(d) > 0).cast("int").alias("up"))
    tied = rows.groupBy(by, "x").agg(F.count("*").alias("t"), F.sum("up").alias("a"))
    before = F.sum("t").over(Window.partitionBy(by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = tied.withColumn("rank", before - (F.col("t") - 1) / 2)
    s = ranked.groupBy(by).agg(F.sum(F.col("rank") * F.col("a")).alias("w"), F.sum("t").alias("n"), F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    n = F.col("n")
    z = (F.col("w") - n * (n + 1) / 4) / F.nullif(F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48), F.lit(0.0))
    return s.select(by, F.col("w"), z.alias("z"), normal_tail(z).alias("p"))
