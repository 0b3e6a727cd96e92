"""Plug-in information measures (nats) from tables of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def joint(df: DataFrame, *columns: str) -> DataFrame:
    """Counts n of the combinations that occur."""
    return df.groupBy(*columns).agg(F.count("*").cast("double").alias("n"))


def _entropy(n: Column) -> Column:
    """Entropy of counts: ln N - sum(n ln n) / N, which needs one pass."""
    return F.log(F.sum(n)) - F.sum(F.when(n > 0, n * F.log(n)).otherwise(0.0)) / F.sum(n)


def entropy(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row h: the entropy of the given columns' marginal distribution."""
    return counts.groupBy(*columns).agg(F.sum("n").alias("n")).agg(_entropy(F.col("n")).alias("h"))


def _with_marginals(counts: DataFrame, x: Sequence[str], y: Sequence[str]) -> DataFrame:
    both = counts.groupBy(*x, *y).agg(F.sum("n").alias("n"))
    w = Window.partitionBy
    return both.withColumns({"nx": F.sum("n").over(w(*x)), "ny": F.sum("n").over(w(*y))})


def conditional_entropy(counts: DataFrame, y: Sequence[str], given: Sequence[str]) -> DataFrame:
    """One row h: H(y | given)."""
    rows = _with_marginals(counts, given, y).where("n > 0")
    return rows.agg((-F.sum(F.col("n") * F.log(F.col("n") / F.col("nx"))) / F.sum("n")).alias("h"))


def mutual_information(counts: DataFrame, x: Sequence[str], y: Sequence[str]) -> DataFrame:
    """One row mi: I(x; y)."""
    rows = _with_marginals(counts, x, y).where("n > 0")
    return rows.agg((F.sum(F.col("n") * F.log(F.col("n") / (F.col("nx") * F.col("ny")))) / F.sum("n") + F.log(F.sum("n"))).alias("mi"))


def divergence(p: DataFrame, q: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row kl: of two count tables, normalised; null where q lacks what p has."""
    w = Window.partitionBy()
    p = p.select(*on, (F.col("n") / F.sum("n").over(w)).alias("_p"))
    q = q.select(*on, (F.col("n") / F.sum("n").over(w)).alias("_q"))
    met = p.where("_p > 0").join(q, list(on), "left")
    return met.agg(F.when(F.min(F.coalesce("_q", F.lit(0.0))) > 0, F.sum(F.col("_p") * F.log(F.col("_p") / F.col("_q")))).alias("kl"))


def shuffled(counts: DataFrame, x: str, y: str, s: str) -> DataFrame:
    """Joint table of x, y, s with x and y independent given s; n keeps each s's total."""
    total = counts.groupBy(s).agg(F.sum("n").alias("ns"))
    a = counts.groupBy(s, x).agg(F.sum("n").alias("a"))
    b = counts.groupBy(s, y).agg(F.sum("n").alias("b"))
    return a.join(b, s).join(total, s).select(x, y, s, (F.col("a") * F.col("b") / F.col("ns")).alias("n"))


def shuffle_information(counts: DataFrame, x: str, y: str, s: str) -> DataFrame:
    """One row: information about s in (x, y) together, after shuffling, and in each alone; synergy."""
    parts = {
        "i": mutual_information(counts, [x, y], [s]),
        "i_shuffled": mutual_information(shuffled(counts, x, y, s), [x, y], [s]),
        "i_x": mutual_information(counts, [x], [s]),
        "i_y": mutual_information(counts, [y], [s]),
    }
    rows = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("name"), F.col("mi").alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    row = rows.agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in parts))
    return row.withColumn("delta_shuffled", F.col("i") - F.col("i_shuffled")).withColumn("synergy", F.col("i") - F.col("i_x") - F.col("i_y"))


def smoothed(counts: DataFrame, columns: Sequence[str], bias: float = 0.5) -> DataFrame:
    """Expected probabilities under a Dirichlet prior of `bias` for each combination that occurs."""
    a = counts.groupBy(*columns).agg((F.sum("n") + bias).alias("a"))
    return a.select(*columns, (F.col("a") / F.sum("a").over(Window.partitionBy())).alias("p"))


def dense(counts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Every combination of whole-number categories below `sizes`, absent ones with n = 0."""
    keys = list(sizes)
    every = counts.sparkSession.range(1)
    for k, n in sizes.items():
        every = every.withColumn(k, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return every.drop("id").join(counts, keys, "left").fillna(0.0, ["n"])
