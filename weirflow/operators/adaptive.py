"""Shuffle tests that stop as soon as a group is decided.

Replicates come in batches that grow by round. After a batch each group has a beta interval for its p-value; groups
whose interval lies on one side of the level are done, and only rows of the others are drawn again. So the work goes
to the few groups near the level, and the number of rounds is the logarithm of the most replicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import grouped, uniforms
from ..functions.special import beta_cdf, beta_quantile
from ..plans.joins import same_join
from ..plans.store import checkpoint_folder

#: Of (rows of the undecided groups, first replicate, number of them): rows of (by, replicate, value).
Sampler = Callable[[DataFrame, int, int], DataFrame]
#: Levels of the p-value, as shares of alpha, that an interval must not contain.
SIDES = {"greater": lambda a: [a], "less": lambda a: [1 - a], "two-sided": lambda a: [a / 2, 1 - a / 2]}


def _judged(alternative: str, alpha: float, tolerance: float):
    """Batches of (n, k): is the group decided, and its p-value, the median of the interval's distribution."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for n, k in batches:
            a, b = k.to_numpy(float) + 0.5, (n - k).to_numpy(float) + 0.5
            done = True
            for level in SIDES[alternative](alpha):
                under = beta_cdf(level, a, b)
                # both ends under the level, or both above it
                done = done & ((under > 1 - tolerance / 2) | (under <= tolerance / 2))
            p = beta_quantile(0.5, a, b)
            if alternative == "less":
                p = 1 - p
            elif alternative == "two-sided":
                p = [2 * x if x < 0.5 else 1 - x for x in p]
            yield pd.DataFrame({"done": done, "p_value": p})

    return F.pandas_udf(run, "done boolean, p_value double")


def adaptive_test(rows: DataFrame, sampler: Sampler, by: Sequence[str], relative_to: float = 0.0, alternative: str = "two-sided", least: int = 16, most: int = 2048, tolerance: float = 0.01, alpha: float = 0.05) -> DataFrame:
    """(by, n, k, p_value, decided): p-values of a sampled value for each group.

    k of a group's n values lie under `relative_to`. `greater` asks whether the value is above it, `less` whether it
    is below, two-sided for either. The first round draws `least`, each next one as many as there are, `most` in all. A
    group is decided when the interval that holds 1 - `tolerance` of its p-value contains neither level of the
    test. `less`, and two-sided p-values beyond a half, are turned round, k with them. Replicates
    without a value count for nothing; a group that gets none stays undecided with a p-value near a half."""
    if alternative not in SIDES:
        raise ValueError("alternative is greater, less or two-sided")
    checkpoint_folder(rows.sparkSession)
    judge = _judged(alternative, alpha, tolerance)
    state = rows.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(False).alias("decided"), F.lit(None).cast("double").alias("p_value")).checkpoint()
    first, size = 0, least
    while first < most:
        size = min(size, most - first)
        going = same_join(rows, state.where("not decided").select(*by), by, "left_semi") if first else rows
        got = sampler(going, first, size).where("value is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("value") < relative_to).cast("long")).alias("_k"))
        after = same_join(state, got, by, "left").withColumns({"n": F.col("n") + F.coalesce("_n", F.lit(0)), "k": F.col("k") + F.coalesce("_k", F.lit(0))}).drop("_n", "_k")
        said = F.when(~F.col("decided"), judge("n", "k"))
        after = after.withColumn("_said", said)
        state = after.select(*by, "n", "k", F.when(F.col("decided"), F.lit(True)).otherwise(F.col("_said.done")).alias("decided"), F.when(F.col("decided"), F.col("p_value")).otherwise(F.col("_said.p_value")).alias("p_value")).checkpoint()
        first, size = first + size, first + size
        if state.where("not decided").isEmpty():
            break
    if alternative == "less":
        state = state.withColumn("k", F.col("n") - F.col("k"))
    elif alternative == "two-sided":
        state = state.withColumn("k", F.when(F.col("k") * 2 > F.col("n"), F.col("n") - F.col("k")).otherwise(F.col("k")))
    return state.select(*by, "n", "k", "p_value", "decided")


def shuffled_mean_difference(x: str, first: Column, key: str, by: Sequence[str], seed: int = 0) -> Sampler:
    """A sampler: the observed difference of two means less that of rows dealt anew to the two sides.

    Each row goes to the first side with that side's share of its group; only sums by replicate are shuffled."""

    def sample(rows: DataFrame, start: int, n: int) -> DataFrame:
        kept = rows.select(*by, F.col(x).cast("double").alias("x"), first.alias("a"), F.col(key).alias("_key")).where("x is not null and a is not null")
        mean = lambda side: F.avg(F.when(side, F.col("x")))
        seen = kept.groupBy(*by).agg((mean(F.col("a")) - mean(~F.col("a"))).alias("seen"), F.avg(F.col("a").cast("double")).alias("share"))
        dealt = same_join(kept, seen, by).select(*by, "x", F.col("_key").cast("string").alias("_key"), "share", "seen")
        # the draws are the work, so few rows of the last groups are dealt to all cores too
        dealt = dealt.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
        kinds = dict(dealt.dtypes)
        shown = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "seen double, replicate int, a double, na long, b double, nb long"])
        sums = dealt.mapInArrow(_dealt_sums(seed, start, n, tuple(by)), shown).groupBy(*by, "replicate", "seen").agg(*(F.sum(c).alias(c) for c in ("a", "na", "b", "nb")))
        side = lambda c: F.col(c) / F.nullif(F.col(f"n{c}"), F.lit(0))
        return sums.select(*by, "replicate", (F.col("seen") - (side("a") - side("b"))).alias("value"))

    return sample


def _dealt_sums(seed: int, start: int, n: int, by: tuple[str, ...]):
    """Batches of (by, x, _key, share, seen) to sums and numbers of the rows dealt to either side, by group and replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, share = batch.column("x").to_numpy(), batch.column("share").to_numpy()
            codes, first = grouped(batch, by)
            own, out = batch.take(first).select([*by, "seen"]), []
            for r, u in enumerate(uniforms(seed, batch.column("_key"), range(start, start + n)), start):
                h = u < share
                sides = []
                for s in (h, ~h):
                    # without rows the sums would be whole numbers
                    sides += [np.bincount(codes[s], x[s], len(first)).astype(float), np.bincount(codes[s], minlength=len(first))]
                out.append(pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(first), r, np.int32)), *map(pa.array, sides)], [*own.schema.names, "replicate", "a", "na", "b", "nb"]))
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()

    return run
