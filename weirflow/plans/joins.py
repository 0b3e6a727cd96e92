"""Join rewrites: band join, stencil join, spine join, null-safe join, replicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def band_join(left: DataFrame, right: DataFrame, at_left: str, at_right: str, low: float, high: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs with low <= right - left < high, as an equi-join on buckets of the band's width.

    Columns of both sides must differ but for `on`. Each left row looks at the two buckets its band can
    touch; the exact bounds remain as a residual predicate, so no pair is made twice or missed."""
    width = float(high - low)
    if width <= 0:
        raise ValueError("the band is empty")
    first = F.floor((F.col(at_left) + F.lit(low)) / F.lit(width))
    looking = left.withColumn("_bucket", F.explode(F.array(first, first + 1)))
    held = right.withColumn("_bucket", F.floor(F.col(at_right) / F.lit(width)))
    lag = F.col(at_right) - F.col(at_left)
    return looking.join(held, [*on, "_bucket"]).where((lag >= low) & (lag < high)).drop("_bucket")


def stencil(grid: DataFrame, offsets: Sequence[tuple[int, int]], row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """(row, col, dr, dc, near): for each cell the values at offsets from it, where there is a cell.

    Every cell posts its value to the cells that look at it: an equi-join on positions."""
    listed = F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets))
    posted = grid.select(F.col(row), F.col(col), F.col(value).alias("near"), F.explode(listed).alias("o"))
    posted = posted.select((F.col(row) - F.col("o.dr")).alias(row), (F.col(col) - F.col("o.dc")).alias(col), "o.dr", "o.dc", "near")
    return grid.select(row, col).join(posted, [row, col])


def spine(counts: DataFrame, key: str, low: int, high: int, fill: dict[str, float]) -> DataFrame:
    """Rows for every key from low to high (exclusive), absent ones filled."""
    every = counts.sparkSession.range(low, high).withColumnRenamed("id", key)
    return every.join(counts, key, "left").fillna(fill)


def same_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names where nulls equal one another; the left's columns stay. The sides may
    descend from the same table."""
    names = {c: f"_same{k}" for k, c in enumerate(on)}
    right = right.withColumnsRenamed(names)
    met = F.lit(True)
    for c in on:
        met = met & F.col(c).eqNullSafe(F.col(names[c]))
    return left.join(right, met, how).drop(*names.values())


def replicates(df: DataFrame, n: int, name: str = "replicate") -> DataFrame:
    """Each row once for each of n replicates."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def draw(seed: int, *keys: Column | str) -> Column:
    """Uniform number in [0, 1) from a seed and keys; the same whatever the partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return bits.cast("double") / F.lit(float(1 << 53))
