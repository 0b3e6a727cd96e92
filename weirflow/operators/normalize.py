"""Normalisers and ranks over a partition of a series. All are window expressions; null values stay null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import ndtri, quotient

EPS = 1e-30


def _w(by):
    return Window.partitionBy(*([by] if isinstance(by, str) else by))


def zeromin(x: str, by) -> Column:
    return F.col(x) - F.min(x).over(_w(by))


def zeromean(x: str, by) -> Column:
    return F.col(x) - F.avg(x).over(_w(by))


def zeromedian(x: str, by) -> Column:
    return F.col(x) - F.percentile(x, F.lit(0.5)).over(_w(by))


def zscore(x: str, by) -> Column:
    return (F.col(x) - F.avg(x).over(_w(by))) / (F.stddev_pop(x).over(_w(by)) + EPS)


def standardize(x: str, by) -> Column:
    return F.col(x) / (F.stddev_pop(x).over(_w(by)) + EPS)


def unitscale(x: str, by) -> Column:
    low = F.min(x).over(_w(by))
    return (F.col(x) - low) / F.nullif(F.max(x).over(_w(by)) - low, F.lit(0.0))


def absunitscale(x: str, by, minor: bool = False) -> Column:
    """Divided by the largest absolute value; with `minor` by the smaller of the two extremes."""
    low, high = F.abs(F.min(x).over(_w(by))), F.abs(F.max(x).over(_w(by)))
    return quotient(F.col(x), F.least(low, high) if minor else F.greatest(low, high))


def unitsum(x: str, by) -> Column:
    return quotient(F.col(x), F.sum(x).over(_w(by)))


def unitlength(x: str, by) -> Column:
    return quotient(F.col(x), F.sqrt(F.sum(F.col(x) * F.col(x)).over(_w(by))))


def deltaovermean(x: str, by) -> Column:
    mean = F.avg(x).over(_w(by))
    return quotient(F.col(x) - mean, mean)


def average_rank(x: str, by) -> Column:
    """Rank from 1, ties sharing their mean rank; null for null."""
    keys = [by] if isinstance(by, str) else list(by)
    order = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    return F.when(F.col(x).isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def uniformize(x: str, by) -> Column:
    return (average_rank(x, by) - 0.5) / F.count(x).over(_w(by))


def uniformize_positive(x: str, by, killeps: float) -> Column:
    """Values up to `killeps` get 0; the rest their rank among themselves over their number, less a half."""
    keys = [by] if isinstance(by, str) else list(by)
    used = F.col(x) > killeps
    order = Window.partitionBy(*keys, used).orderBy(x)
    ties = F.count("*").over(Window.partitionBy(*keys, used, x))
    n = F.count("*").over(Window.partitionBy(*keys, used))
    return F.when(used, (F.rank().over(order) + (ties - 1) / 2 - 0.5) / n).when(F.col(x).isNotNull(), F.lit(0.0))


def gaussianize(x: str, by) -> Column:
    return ndtri(average_rank(x, by) / (F.count(x).over(_w(by)) + 1))


def topercentiles(x: str, by, tie: str) -> Column:
    """Ordinal rank as a percentage; ties in order of `tie`."""
    keys = [by] if isinstance(by, str) else list(by)
    order = Window.partitionBy(*keys).orderBy(x, tie)
    return 100.0 * (F.row_number().over(order) - 1) / F.nullif(F.count("*").over(_w(by)) - 1, F.lit(0))


def nanrank(x: str, by, mode: str = "fraction") -> Column:
    """Average rank as a fraction of, percentage of, or count among the non-null values."""
    rank = average_rank(x, by)
    n = F.count(x).over(_w(by))
    return {"fraction": rank / n, "percentile": 100.0 * rank / n, "count": rank}[mode]


METHODS = {"zeromean": zeromean, "zeromedian": zeromedian, "zscore": zscore, "gaussian": gaussianize, "rank": average_rank, "percentile": uniformize, "unitscale": unitscale, "unitsum": unitsum}


def normalize(df: DataFrame, x: str, by, method: str, to: str) -> DataFrame:
    """Add one of METHODS as column `to`, over finite values."""
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.col(x))
    return df.withColumn(x, finite).withColumn(to, METHODS[method](x, by))
