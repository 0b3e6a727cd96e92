"""Spectra of long series over overlapping windows: a series is as many rows as it has windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def windows(df: DataFrame, by: str, i: str, values: Sequence[str], n: int = 64, step: int = 32) -> DataFrame:
    """(by, start, one array for each of `values`): windows of n samples, `step` apart, that cover a series.

    `i` numbers the samples of a series from 0 without gaps. A series of under n samples is one window of its own
    length; the last window of a longer one ends with it. No row holds more than n samples, so a
    series of any length is spread over tasks by its windows. Samples with a null value are null there."""
    sizes = df.groupBy(by).agg((F.max(i) + 1).alias("_n"))
    rows = df.select(by, F.col(i).alias("_i"), *(F.col(v).cast("double").alias(v) for v in values)).join(sizes, by)
    first = F.greatest(F.ceil((F.col("_i") - (n - 1)) / step), F.lit(0))
    last = F.least(F.floor(F.col("_i") / step), F.floor(F.greatest(F.col("_n") - n, F.lit(0)) / step))
    regular = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    starts = F.transform(regular, lambda k: k * step)
    tail = F.col("_n") - n
    extra = (tail > 0) & (tail % step != 0) & (F.col("_i") >= tail)
    starts = F.when(extra, F.concat(starts, F.array(tail.cast("long")))).otherwise(starts)
    cut = rows.select(by, F.explode(starts).alias("start"), "_i", *values)
    held = cut.groupBy(by, "start").agg(F.sort_array(F.collect_list(F.struct("_i", *values))).alias("_s"))
    return held.select(by, "start", *(F.col(f"_s.{v}").alias(v) for v in values))


def averaged(df: DataFrame, by: str, i: str, values: Sequence[str], kernel: Callable[..., dict[str, np.ndarray]], columns: Sequence[str], n: int = 64, step: int = 32, least: int = 8) -> DataFrame:
    """(by, frequency, mean of each of `columns` over the windows of a series).

    `kernel` takes a window's arrays and returns frequency and `columns`. Windows with a null or of under `least`
    samples say nothing."""
    cut = windows(df, by, i, values, n, step)
    kind = dict(df.dtypes)[by]

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                parts = [np.asarray(x, float) for x in row[2:]]
                if len(parts[0]) >= least and not any(np.isnan(x).any() for x in parts):
                    yield pd.DataFrame({by: row[0]} | kernel(*parts))

    spectra = cut.mapInPandas(run, f"{by} {kind}, frequency double, " + ", ".join(f"{c} double" for c in columns))
    return spectra.groupBy(by, "frequency").agg(*(F.avg(c).alias(c) for c in columns))
