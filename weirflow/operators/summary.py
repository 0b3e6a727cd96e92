"""Summaries: descriptions, weighted moments, outliers, covariances, effect sizes, circular statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import wrap

PERCENTS = (1, 5, 10, 90, 95, 99)


def describe(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """N, extremes, mean, sample variance, population skew and excess kurtosis, deviation, quartiles,
    percentiles, in one pass."""
    shares = [0.25, 0.5, 0.75, *(p / 100 for p in PERCENTS)]
    made = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"), F.stddev_pop(x).alias("std"), F.percentile(x, F.array(*map(F.lit, shares))).alias("_p"),
    )
    names = ["q1", "median", "q3", *(f"p{p:02d}" for p in PERCENTS)]
    return made.select(*by, "n", "min", "max", "mean", "var", "skew", "kurt", "std", *(F.col("_p")[k].alias(n) for k, n in enumerate(names)))


def _weighted(df: DataFrame, x: str, w: str, by: Sequence[str]) -> DataFrame:
    made = df.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(F.col(w) * F.col(x)).alias("_wx"), F.sum(F.col(w) * F.col(x) * F.col(x)).alias("_wxx"))
    mean = F.col("_wx") / F.col("n")
    return made.select(*by, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("_wxx") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def weighted_avg_and_std(df: DataFrame, x: str, w: str, by: Sequence[str] = ()) -> DataFrame:
    return _weighted(df, x, w, by).drop("n")


def outliers(df: DataFrame, x: str, by: str, percent: float = 10.0, side: str = "both", to: str = "outlier") -> DataFrame:
    """Flag values strictly outside the percentile limits of their group."""
    share = percent / 100 / (2 if side == "both" else 1)
    w = Window.partitionBy(by)
    low, high = F.col(x) < F.percentile(x, F.lit(share)).over(w), F.col(x) > F.percentile(x, F.lit(1 - share)).over(w)
    return df.withColumn(to, {"both": low | high, "left": low, "right": high}[side])


def nrmse(estimate: str, true: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(estimate) - F.col(true), 2))) / F.stddev_pop(true)


def rms(x: str) -> Column:
    return F.sqrt(F.avg(F.col(x) * F.col(x)))


def span(x: str) -> Column:
    return F.max(x) - F.min(x)


def covariance(df: DataFrame, columns: Sequence[str], reg: float = 0.0) -> DataFrame:
    """(a, b, cov) population covariances of all pairs a <= b, from one aggregate row."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*(F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"`{a}|{b}`") + F.lit(reg if a == b else 0.0)).alias("cov")) for a, b in pairs))).alias("p")).select("p.*")


#: Upper bounds of the labels of an effect's absolute size; above the last it is huge.
EFFECTS = ((0.01, "Very small"), (0.2, "Small"), (0.5, "Medium"), (0.8, "Large"), (1.2, "Very large"))


def cohen_d(df: DataFrame, x: str, first: Column) -> DataFrame:
    """Pooled-deviation effect size between rows where `first` holds and the rest, and its label."""
    group = df.select(F.col(x).alias("x"), first.alias("g")).agg(*(f(F.when(F.col("g") == F.lit(side), F.col("x"))).alias(f"{name}{int(side)}") for side in (True, False) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    rows = group.select(((F.col("m1") - F.col("m0")) / pooled).alias("d"))
    label = F.lit("Huge")
    for bound, name in reversed(EFFECTS):
        label = F.when(F.abs("d") <= bound, F.lit(name)).otherwise(label)
    return rows.select("d", label.alias("label"))


def weighted_ttest(df: DataFrame, x: str, w: str) -> DataFrame:
    """Mean, standard error, t and degrees of freedom of a weighted one-sample test; n is the weights' sum."""
    sem = F.col("std") / F.sqrt(F.col("n") - 1)
    return _weighted(df, x, w, ()).select("mean", sem.alias("sem"), (F.col("mean") / sem).alias("t"), (F.col("n") - 1).alias("dof"))


def circmean(x: Column) -> Column:
    return F.atan2(F.avg(F.sin(x)), F.avg(F.cos(x)))


def resultant(x: Column) -> Column:
    """Length of the mean unit vector: order of a population of phases."""
    return F.sqrt(F.pow(F.avg(F.cos(x)), 2) + F.pow(F.avg(F.sin(x)), 2))


def circvar(x: Column) -> Column:
    return 1 - resultant(x)


def polar_std(r: Column) -> Column:
    return F.sqrt(-2 * F.log(r))


def squared_first_moment(x: Column, unbiased: bool = True) -> Column:
    """Squared resultant; unbiased: (n r - 1) / (n - 1)."""
    r, n = F.pow(F.avg(F.cos(x)), 2) + F.pow(F.avg(F.sin(x)), 2), F.count(x)
    return (n * r - 1) / (n - 1) if unbiased else r


def synchrony(re: Column, im: Column) -> Column:
    """Length of the mean over the mean length."""
    return F.sqrt(F.pow(F.avg(re), 2) + F.pow(F.avg(im), 2)) / F.avg(F.sqrt(re * re + im * im))


def dispersion(re: str, im: str) -> Column:
    """Fourth root of the determinant of the two parts' covariance."""
    return F.pow(F.var_pop(re) * F.var_pop(im) - F.pow(F.covar_pop(re, im), 2), 0.25)


def circcenter(df: DataFrame, x: str, by: str, to: str) -> DataFrame:
    w = Window.partitionBy(by)
    mean = F.atan2(F.avg(F.sin(x)).over(w), F.avg(F.cos(x)).over(w))
    return df.withColumn(to, wrap(F.col(x) - mean))


def circcorr(df: DataFrame, a: str, b: str, by: str, component: str = "sin") -> DataFrame:
    """Correlation of one component (sin, or cos) of two angles centred on their means, by group."""
    f = {"sin": F.sin, "cos": F.cos}[component]
    rows = circcenter(circcenter(df, a, by, "_a"), b, by, "_b")
    return rows.groupBy(by).agg(F.corr(f("_a"), f("_b")).alias("r"))


def wrapped_error(a: Column, b: Column, mode: str = "L1") -> Column:
    """Mean absolute, or root mean square, wrapped difference."""
    d = wrap(a - b)
    return F.avg(F.abs(d)) if mode == "L1" else F.sqrt(F.avg(d * d))
