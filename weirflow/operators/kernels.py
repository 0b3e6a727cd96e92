"""Running numpy kernels over series: one group of a series in a task, Arrow in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


#: Rows of results that a task puts together before it sends them.
TOGETHER = 50_000


def _sent(by: str, made: Iterable[tuple[Any, dict[str, np.ndarray]]]) -> Iterator[pd.DataFrame]:
    """Frames of many series' results, as one frame for each series costs more than its kernel."""
    keys, parts, held = [], [], 0

    def frame():
        counts = [len(next(iter(p.values()))) for p in parts]
        return pd.DataFrame({by: pd.Series(keys, dtype=object if None in keys else None).repeat(counts).reset_index(drop=True)} | {c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

    for key, part in made:
        keys.append(key)
        parts.append(part)
        held += len(next(iter(part.values())))
        if held >= TOGETHER:
            yield frame()
            keys, parts, held = [], [], 0
    if parts:
        yield frame()


def map_series(df: DataFrame, by: str, i: str, x: str, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, least: int = 2) -> DataFrame:
    """Apply `kernel` to each series' values in order of i; it returns columns of equal length.

    A series is one row of an array while it is worked on, so many short ones share an Arrow batch; one
    series must fit a worker. Series with a null or under `least` samples give no rows. `schema` lists the
    kernel's columns, before which `by` stands."""
    packed = df.where(F.col(x).isNotNull()).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(i).alias("i"), F.col(x).cast("double").alias("x")))).alias("_s"))
    packed = packed.select(by, F.col("_s.x").alias("x"))
    kind = dict(df.dtypes)[by]

    def run(batches):
        for batch in batches:
            yield from _sent(by, ((key, kernel(np.asarray(values, float))) for key, values in zip(batch[by], batch["x"], strict=True) if len(values) >= least))

    return packed.mapInPandas(run, f"{by} {kind}, {schema}")


def map_pairs(df: DataFrame, by: str, i: str, x: str, y: str, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, least: int = 2) -> DataFrame:
    """As map_series, for two values of a sample."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    packed = ok.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(i).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("_s"))
    packed = packed.select(by, F.col("_s.x").alias("x"), F.col("_s.y").alias("y"))
    kind = dict(df.dtypes)[by]

    def run(batches):
        for batch in batches:
            yield from _sent(by, ((key, kernel(np.asarray(a, float), np.asarray(b, float))) for key, a, b in zip(batch[by], batch["x"], batch["y"], strict=True) if len(a) >= least))

    return packed.mapInPandas(run, f"{by} {kind}, {schema}")
