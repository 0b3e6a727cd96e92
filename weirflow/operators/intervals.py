"""Operators on binary series and gaps: runs, edges, dilation, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _order(by: str, i: str):
    return Window.partitionBy(by).orderBy(i)


def with_runs(df: DataFrame, flag: str, by: str, i: str) -> DataFrame:
    """Add _run (number of the run of equal flags) and _length (its samples)."""
    turn = F.coalesce((F.col(flag) != F.lag(flag).over(_order(by, i))).cast("int"), F.lit(0))
    rows = df.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(_order(by, i))).drop("_turn")
    return rows.withColumn("_length", F.count("*").over(Window.partitionBy(by, "_run")))


def get_edges(df: DataFrame, flag: str, by: str, i: str, pad: bool = True) -> DataFrame:
    """(by, start, stop) of each true stretch, stop exclusive; without `pad` cut-off stretches go."""
    ends = Window.partitionBy(by)
    rows = with_runs(df, flag, by, i).withColumn("_low", F.min(i).over(ends)).withColumn("_high", F.max(i).over(ends))
    runs = rows.where(F.col(flag)).groupBy(by, "_run").agg(F.min(i).alias("start"), (F.max(i) + 1).alias("stop"), F.first("_low").alias("_low"), F.first("_high").alias("_high"))
    return (runs if pad else runs.where((F.col("start") > F.col("_low")) & (F.col("stop") <= F.col("_high")))).select(by, "start", "stop")


def set_edges(edges: DataFrame, lengths: DataFrame, by: str) -> DataFrame:
    """(by, i, flag) for every i below the series' length n, true inside an interval."""
    inside = edges.where("stop > start").select(by, F.explode(F.sequence("start", F.col("stop") - 1)).alias("i")).distinct().withColumn("flag", F.lit(True))
    every = lengths.where("n > 0").select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return every.join(inside, [by, "i"], "left").fillna({"flag": False})


def remove_gaps(df: DataFrame, flag: str, by: str, i: str, cutoff: int, to: str) -> DataFrame:
    """False runs of at most `cutoff` samples become true."""
    return with_runs(df, flag, by, i).withColumn(to, F.col(flag) | (F.col("_length") <= cutoff)).drop("_run", "_length")


def remove_short(df: DataFrame, flag: str, by: str, i: str, cutoff: int, to: str) -> DataFrame:
    """True runs of at most `cutoff` samples become false."""
    return with_runs(df, flag, by, i).withColumn(to, F.col(flag) & (F.col("_length") > cutoff)).drop("_run", "_length")


def reach(k: int, legacy: bool = False) -> int:
    return k * (k + 1) // 2 if legacy else k


def dilate(flag: str, by: str, i: str, k: int = 5, legacy: bool = False) -> Column:
    """True within k samples of a true one; `legacy` reaches k (k + 1) / 2."""
    r = reach(k, legacy)
    return F.max(flag).over(_order(by, i).rowsBetween(-r, r))


def erode(flag: str, by: str, i: str, k: int = 5, legacy: bool = False) -> Column:
    """True where all samples within k are; samples outside the series don't count."""
    r = reach(k, legacy)
    return F.min(flag).over(_order(by, i).rowsBetween(-r, r))


def split_pieces(df: DataFrame, x: str, by: str, i: str, threshold: float, to: str = "piece") -> DataFrame:
    """Number the pieces from 0: a new one begins where a step's size exceeds the threshold."""
    step = F.coalesce((F.abs(F.col(x) - F.lag(x).over(_order(by, i))) > threshold).cast("long"), F.lit(0))
    return df.withColumn("_step", step).withColumn(to, F.sum("_step").over(_order(by, i))).drop("_step")


def interpolate_gaps(df: DataFrame, x: str, by: str, i: str, to: str, legacy: bool = False) -> DataFrame:
    """Null stretches between two values filled on the line between them; ends stay null.

    `legacy` starts a fill at the left value itself: the k-th of n missing gets a + (b - a) (k - 1) / n."""
    before = _order(by, i).rowsBetween(Window.unboundedPreceding, 0)
    after = _order(by, i).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(x).isNotNull(), F.struct(F.col(i).alias("i"), F.col(x).alias("x")))
    rows = df.withColumn("_at", at)
    rows = rows.withColumn("_a", F.last("_at", True).over(before)).withColumn("_b", F.first("_at", True).over(after)).drop("_at")
    gap = F.col("_b.i") - F.col("_a.i")
    share = (F.col(i) - F.col("_a.i") - 1) / (gap - 1) if legacy else (F.col(i) - F.col("_a.i")) / gap
    filled = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * share
    return rows.withColumn(to, F.coalesce(F.col(x), filled)).drop("_a", "_b")
