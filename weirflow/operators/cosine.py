"""Discrete cosine transforms of grids: low-pass, compact and up-sampled forms, for many frames at once.

A grid is a long table (row, col, value), absent cells being zero. A transform goes along one axis and then the other;
each is a sum over the cells of a line, added up before the shuffle. Frames may differ in size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.joins import same_join


def _sized(grid: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Cells with the height `_h` and width `_w` of their frame, counted from row and column 0."""
    keys = list(by) or ["_frame"]
    rows = grid if by else grid.withColumn("_frame", F.lit(0))
    rows = rows.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    sizes = rows.groupBy(*keys).agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    return same_join(rows.where("value is not null and not isnan(value)"), sizes, keys), [*keys, "_h", "_w"]


def _along(rows: DataFrame, keys: Sequence[str], axis: str, many: Column, weight: Callable[[Column, Column], Column]) -> DataFrame:
    """Sums over `axis` of value times weight(k, place), for k from 0 to `many` - 1, which takes the axis' name."""
    other = "col" if axis == "row" else "row"
    dealt = rows.select(*keys, other, F.col(axis).alias("_at"), "value", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias(axis))
    return dealt.groupBy(*keys, "row", "col").agg(F.sum(F.col("value") * weight(F.col(axis), F.col("_at"))).alias("value"))


def _cosine(n: str) -> Callable[[Column, Column], Column]:
    """Orthonormal: half-sample mirrored ends."""
    n_ = F.col(n)
    return lambda k, i: F.sqrt(F.when(k == 0, 1.0).otherwise(2.0) / n_) * F.cos(math.pi * (2 * i + 1) * k / (2 * n_))


def transform(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, row, col, value): orthonormal cosine coefficients by their numbers of half waves."""
    rows, keys = _sized(grid, by)
    return _forward(rows, keys).select(*by, "row", "col", "value")


def _forward(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = _along(rows, keys, "row", F.col("_h"), _cosine("_h"))
    return _along(rows, keys, "col", F.col("_w"), _cosine("_w"))


def _back(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    for axis, n in (("row", "_h"), ("col", "_w")):
        rows = _along(rows, keys, axis, F.col(n), lambda i, k, f=_cosine(n): f(k, i))
    return rows


def share(cutoff: float, spacing: float, fine: int) -> Column:
    """The part of a coefficient's square in the frequency plane that lies within 1 / cutoff, by fine x fine points."""
    if fine % 2 != 1:
        raise ValueError("fine is odd")
    steps = [(j - fine // 2) / fine for j in range(fine)]
    squared = lambda k, n, a: F.pow((F.col(k) + a) / (2.0 * F.col(n) * spacing), 2)
    inside = [(squared("row", "_h", a) + squared("col", "_w", b) <= (1.0 / cutoff) ** 2).cast("int") for a in steps for b in steps]
    total = inside[0]
    for one in inside[1:]:
        total = total + one
    return total / float(fine * fine)


def low_pass(grid: DataFrame, cutoff: float, spacing: float = 1.0, fine: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Grids without waves shorter than `cutoff`, their ends mirrored. `fine` = 1 cuts sharply; more softens the cut
    by the share of a coefficient's square that is within it. Coefficients wholly beyond it are not sent back."""
    rows, keys = _sized(grid, by)
    kept = _forward(rows, keys).withColumn("value", F.col("value") * share(cutoff, spacing, fine)).where("value != 0")
    cells = _back(kept, keys)
    every = rows.select(*keys).distinct().withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_h") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w") - 1)))
    out = same_join(every, cells, [*keys, "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return out.select(*by, "row", "col", "value")


def compact(grid: DataFrame, cutoff: float, spacing: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """The low-passed grids on as few rows and columns as hold their waves; samples lie evenly over the same extent."""
    rows, keys = _sized(grid, by)
    kept = _forward(rows, keys).where((share(cutoff, spacing, 1) > 0))
    sizes = kept.groupBy(*keys).agg((F.max("row") + 1).alias("_hs"), (F.max("col") + 1).alias("_ws"))
    kept = same_join(kept, sizes, keys)
    scale = F.sqrt(F.col("_hs") * F.col("_ws") / (F.col("_h") * F.col("_w")))
    small = kept.select(*by or ["_frame"], F.col("_hs").alias("_h"), F.col("_ws").alias("_w"), "row", "col", (F.col("value") * scale).alias("value"))
    return _back(small, keys).select(*by, "row", "col", "value")


def up_sample(grid: DataFrame, factor: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Grids with `factor` times as many steps, through the same values: a cosine series whose ends are mirrored at
    the outermost samples. Rows and columns are counted in the finer steps."""
    if factor < 1:
        raise ValueError("factor is 1 or more")
    rows, keys = _sized(grid, by)
    for axis, n in (("row", "_h"), ("col", "_w")):
        last = F.greatest(F.col(n) - 1, F.lit(1))
        half = lambda k, n=n: F.when((k == 0) | (k == F.col(n) - 1), 0.5).otherwise(1.0)
        alone = F.col(n) == 1
        rows = _along(rows, keys, axis, F.col(n), lambda k, i, last=last, half=half, alone=alone: F.when(alone, 1.0).otherwise(2.0 / last * half(k) * half(i) * F.cos(math.pi * k * i / last)))
        rows = _along(rows, keys, axis, (F.col(n) - 1) * factor + 1, lambda i, k, last=last: F.cos(math.pi * k * i / (last * factor)))
    return rows.select(*by, "row", "col", "value")
