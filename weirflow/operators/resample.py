"""Resampling with seeded draws that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.joins import draw, replicates


def poisson_weight(u: Column, most: int = 12) -> Column:
    """Poisson(1) number of a uniform one: how often a bootstrap replicate takes a row."""
    out, total, term = F.lit(most), 0.0, 2.718281828459045**-1
    bounds = []
    for k in range(most):
        total += term
        term /= k + 1
        bounds.append(total)
    for k in reversed(range(most)):
        out = F.when(u < bounds[k], F.lit(k)).otherwise(out)
    return out


def bootstrap_mean(df: DataFrame, x: str, key: str, n: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """(by, replicate, mean): Poisson bootstrap. Rows are spread over replicates and added up before the
    shuffle, so only sums move."""
    rows = replicates(df.select(*by, x, key), n).withColumn("_w", poisson_weight(draw(seed, F.col(key), F.col("replicate"))))
    return rows.groupBy(*by, "replicate").agg((F.sum(F.col("_w") * F.col(x)) / F.nullif(F.sum("_w"), F.lit(0))).alias("mean"))


def interval(samples: DataFrame, x: str, by: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    made = samples.groupBy(*by).agg(F.percentile(x, F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail))).alias("_p"))
    return made.select(*by, F.col("_p")[0].alias("low"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("high"))


def permutation_test(df: DataFrame, x: str, first: Column, key: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """(observed, p): two-sided label permutation of a difference of means.

    A replicate deals each row to the first group with that group's share, by a seeded draw; its mean
    difference comes from sums alone. p is (exceeding + 1) / (n + 1)."""
    rows = df.select(F.col(x).alias("x"), first.alias("g"), F.col(key).alias("k")).where("x is not null and g is not null")
    a, b, share = rows.agg(F.avg(F.when(F.col("g"), F.col("x"))), F.avg(F.when(~F.col("g"), F.col("x"))), F.avg(F.col("g").cast("double"))).first()
    if a is None or b is None:
        return df.sparkSession.createDataFrame([(None, None)], "observed double, p double")
    dealt = replicates(rows, n).withColumn("h", draw(seed, F.col("k"), F.col("replicate")) < share)
    made = dealt.groupBy("replicate").agg((F.avg(F.when(F.col("h"), F.col("x"))) - F.avg(F.when(~F.col("h"), F.col("x")))).alias("d"))
    return made.agg(F.lit(a - b).alias("observed"), ((F.sum((F.abs("d") >= abs(a - b)).cast("int")) + 1) / (F.count("d") + 1)).alias("p"))


def blocks_bootstrap(df: DataFrame, by: str, i: str, length: int, seed: int = 0, replace: bool = True) -> DataFrame:
    """Series rebuilt from whole blocks of `length` samples, drawn with or without replacement.

    Slots ask for blocks by number, an equi-join; without replacement blocks are ranked by a draw."""
    rows = df.withColumn("_block", F.floor(F.col(i) / F.lit(length)).cast("long"))
    size = rows.groupBy(by).agg((F.floor((F.max(i) + 1) / F.lit(length))).cast("long").alias("_n")).where("_n > 0")
    slots = size.select(by, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_slot"))
    if replace:
        slots = slots.withColumn("_block", F.floor(draw(seed, F.col(by), F.col("_slot")) * F.col("_n")).cast("long"))
    else:
        order = Window.partitionBy(by).orderBy(draw(seed, F.col(by), F.col("_slot")), "_slot")
        slots = slots.withColumn("_block", F.row_number().over(order).cast("long") - 1)
    met = rows.join(slots, [by, "_block"])
    return met.withColumn("to", F.col("_slot") * length + F.col(i) % length).drop("_block", "_n", "_slot")


def folds(i: Column, n: Column, k: int) -> Column:
    """Contiguous fold from 0 of a place among n; the last takes the remainder."""
    return F.least(F.floor(i / F.floor(n / k)), F.lit(k - 1)).cast("long")


def balanced_folds(lengths: DataFrame, key: str, length: str, k: int) -> DataFrame:
    """(key, fold) of trials so that folds hold about equal shares of the total length, in order of key.

    The window goes over one row for each trial."""
    w = Window.orderBy(key)
    total = F.sum(length).over(Window.partitionBy())
    middle = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(length) / 2
    return lengths.select(key, length, F.least(F.floor(middle * k / total), F.lit(k - 1)).cast("long").alias("fold"))
