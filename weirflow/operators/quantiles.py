"""Bootstrap and permutation of order statistics and of any weighted aggregate.

A replicate weighs rows instead of copying them. Its quantiles are exact and take two passes: weights by bin of
equal depth give the bin and the rank in it of every quantile asked for, then weights by value within those bins
give the value. So what a task sorts is a bin of a group, not the group. Draws are digits of an MD5 of seed, key
and replicate, so any engine can repeat them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.joins import replicates, same_join
from ..plans.store import checkpoint_folder

#: Bins of equal depth in each group.
BINS = 128
#: Tasks for each core that rows are dealt to before replicates are drawn.
DEAL = 2


def uniform(seed: int, *keys: str) -> Column:
    """Number in [0, 1) of 52 bits from a seed and columns; null counts as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(u: Column, rate: Column | float = 1.0) -> Column:
    """Poisson number of a uniform one, for rates up to some 700: how many terms of the distribution u exceeds."""
    rate = F.lit(rate).cast("double") if isinstance(rate, (int, float)) else rate.cast("double")
    most = F.ceil(rate + 12 * F.sqrt(rate) + 12).cast("int")
    first = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("total"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * rate / k
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"), (s["n"] + (s["total"] <= u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), most), first, step, lambda s: s["n"])


def poisson_bounds(rate: Column, n: int = 8) -> Column:
    """Struct of the first `n` cumulated probabilities b0, b1, ... of a Poisson distribution, added up as `poisson` does."""
    rate = rate.cast("double")
    term = total = F.exp(-rate)
    out = [total.alias("b0")]
    for k in range(1, n):
        term = term * rate / k
        total = total + term
        out.append(total.alias(f"b{k}"))
    return F.struct(*out)


def poisson_within(u: Column, bounds: Column, rate: Column, n: int = 8) -> Column:
    """`poisson` from bounds known beforehand, and summed anew only for the few numbers beyond them."""
    out = poisson(u, rate)
    for k in reversed(range(n)):
        out = F.when(u < bounds[f"b{k}"], F.lit(k)).otherwise(out)
    return out


def unit_bounds() -> list[float]:
    """First twelve cumulated probabilities of a Poisson distribution of rate 1."""
    term, total, bounds = 2.718281828459045**-1, 0.0, []
    for k in range(12):
        total += term
        term /= k + 1
        bounds.append(total)
    return bounds


def unit_poisson(u: Column) -> Column:
    """Poisson number of rate 1 from bounds known beforehand, twelve at most."""
    out, bounds = F.lit(12), unit_bounds()
    for k in reversed(range(12)):
        out = F.when(u < bounds[k], F.lit(k)).otherwise(out)
    return out


def weighted_quantiles(df: DataFrame, x: str, n: int, probs: Sequence[float], arms: Mapping[str, Column], by: Sequence[str] = (), draw: Column | None = None) -> DataFrame:
    """(by, replicate, arm, p, value): quantiles of `n` weighted replicates of each group.

    `arms` are whole-number weights as columns of `df`, `replicate` and `_u`, which is `draw` worked out once for a row
    and replicate; an arm is a sample of its own. Quantiles
    lie between ranks as numpy's do: at (W - 1) p of the W values that the weights stand for. Null and NaN values
    are left out; replicates of no weight have no row."""
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).withColumn("_x", F.col(x).cast("double"))
    rows, keys = _keyed(rows, by)
    checkpoint_folder(df.sparkSession)
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_x", [k / BINS for k in range(1, BINS)], 100 * BINS).alias("_cuts"))
    if n > 1:
        # a file's one row group is one task, which would draw every replicate of every row
        rows = rows.repartition(DEAL * df.sparkSession.sparkContext.defaultParallelism)
    # the cuts below a value: first every 16th, then those from there on
    below = lambda at: F.coalesce((F.get("_cuts", at) < F.col("_x")).cast("int"), F.lit(0))
    rows = same_join(rows, cuts, keys).withColumn("_coarse", sum((below(F.lit(k)) for k in range(15, BINS - 1, 16)), F.lit(0)))
    rows = rows.withColumn("_bin", F.col("_coarse") * 16 + sum((below(F.col("_coarse") * 16 + k) for k in range(15)), F.lit(0))).drop("_cuts", "_coarse")
    weights = [w.cast("long").alias(f"_w{k}") for k, w in enumerate(arms.values())]
    listed = lambda: F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"_w{k}").alias("w")) for k, a in enumerate(arms))))
    sums = [F.sum(f"_w{k}").alias(f"_w{k}") for k in range(len(arms))]
    drawn = lambda r: replicates(r, n).withColumn("_u", F.lit(0.0) if draw is None else draw).select("*", *weights)

    bins = drawn(rows).groupBy(*keys, "replicate", "_bin").agg(*sums).select(*keys, "replicate", "_bin", listed().alias("a")).select(*keys, "replicate", "_bin", "a.arm", "a.w")
    group = Window.partitionBy(*keys, "replicate", "arm")
    bins = bins.withColumn("upto", F.sum("w").over(group.orderBy("_bin"))).withColumn("total", F.sum("w").over(group))
    place = (F.col("total") - 1) * F.col("p")
    asked = bins.where("w > 0").select("*", F.explode(F.array(*map(F.lit, map(float, probs)))).alias("p"))
    asked = asked.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(place).alias("rank")))).alias("r"))
    asked = asked.select(*keys, "replicate", "_bin", "arm", "p", (place - F.floor(place)).alias("part"), "r.side", "r.rank", (F.col("upto") - F.col("w")).alias("before"), "upto")
    asked = asked.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))).drop("upto").checkpoint()

    used = asked.select(*keys, "_bin").distinct()
    inside = same_join(rows, used, [*keys, "_bin"], "left_semi")
    values = drawn(inside).groupBy(*keys, "replicate", "_bin", "_x").agg(*sums).select(*keys, "replicate", "_bin", "_x", listed().alias("a"))
    values = values.select(*keys, "replicate", "_bin", "_x", "a.arm", "a.w").where("w > 0")
    values = values.withColumn("upto", F.sum("w").over(Window.partitionBy(*keys, "replicate", "_bin", "arm").orderBy("_x")))
    on = [*keys, "replicate", "_bin", "arm"]
    found = same_join(values, asked, on).where(F.col("upto") + F.col("before") > F.col("rank"))
    found = found.groupBy(*keys, "replicate", "arm", "p", "part", "side").agg(F.min("_x").alias("_x"))
    low, high = (F.max(F.when(F.col("side") == k, F.col("_x"))) for k in (0, 1))
    out = found.groupBy(*keys, "replicate", "arm", "p", "part").agg(low.alias("low"), high.alias("high"))
    return out.select(*by, "replicate", "arm", "p", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("value"))


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The table and its group columns; without any, all rows are one group."""
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def exact_quantiles(df: DataFrame, x: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, p, value): exact quantiles of groups of any size."""
    return weighted_quantiles(df.select(*by, x), x, 1, probs, {"": F.lit(1)}, by).drop("replicate", "arm")


def bootstrap_quantiles(df: DataFrame, x: str, key: str, n: int, probs: Sequence[float] = (0.5,), by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(by, replicate, p, value): quantiles of `n` Poisson bootstrap samples; `key` tells rows apart."""
    rows = df.select(*by, x, F.col(key).alias("_key"))
    return weighted_quantiles(rows, x, n, probs, {"": unit_poisson(F.col("_u"))}, by, uniform(seed, "_key", "replicate")).drop("arm")


def bootstrap_statistic(df: DataFrame, key: str, n: int, statistic: Callable[[Column], Column], by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(by, replicate, value): any aggregate that takes weights, on `n` Poisson bootstrap samples.

    `statistic` gets the weight column and returns an aggregate; sums are added up before the shuffle."""
    rows = replicates(df.withColumn("_key", F.col(key)), n)
    rows = rows.withColumn("_u", uniform(seed, "_key", "replicate")).withColumn("_w", unit_poisson(F.col("_u")).cast("double"))
    return rows.groupBy(*by, "replicate").agg(statistic(F.col("_w")).alias("value"))


def _two_samples(df: DataFrame, x: str, first: Column, key: str, by: Sequence[str], bounds: bool = False) -> DataFrame:
    """Rows with side, and the sizes of both sides of their group as `_na` and `_nb`; with `bounds` those of the Poisson
    numbers of their ratio, worked out once for a group."""
    rows = df.select(*by, F.col(x).cast("double").alias("x"), first.alias("_a"), F.col(key).alias("_key")).where("x is not null and not isnan(x) and _a is not null")
    sizes = rows.groupBy(*by).agg(F.sum(F.col("_a").cast("long")).alias("_na"), F.sum((~F.col("_a")).cast("long")).alias("_nb"))
    sizes = sizes.where("_na > 0 and _nb > 0")
    if bounds:
        sizes = sizes.withColumn("_bounds", poisson_bounds(F.col("_na") / F.col("_nb")))
    return same_join(rows, sizes, by)


def _observed(rows: DataFrame, p: float, by: Sequence[str]) -> DataFrame:
    made = weighted_quantiles(rows, "x", 1, [p], {"a": F.col("_a").cast("int"), "b": (~F.col("_a")).cast("int")}, by)
    side = lambda a: F.max(F.when(F.col("arm") == a, F.col("value")))
    return made.groupBy(*by).agg(side("a").alias("first"), side("b").alias("second"))


def null_quantile_test(df: DataFrame, x: str, first: Column, key: str, n: int = 1000, p: float = 0.5, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(by, first, second, p_value): is a quantile of the first sample further from the second's than chance has it?

    `n` samples of about the first's size are drawn with replacement from the second; the p-value is the share of
    them whose quantile is further from the second's own than the first's is. Groups with one side have no row."""
    df, keys = _keyed(df, by)
    rows = _two_samples(df, x, first, key, keys, bounds=True)
    seen = _observed(rows, p, keys)
    weight = F.when(F.col("_a"), F.lit(0)).otherwise(poisson_within(F.col("_u"), F.col("_bounds"), F.col("_na") / F.col("_nb")))
    drawn = weighted_quantiles(rows, "x", n, [p], {"null": weight}, keys, uniform(seed, "_key", "replicate")).select(*keys, "value")
    further = F.abs(F.col("value") - F.col("second")) > F.abs(F.col("first") - F.col("second"))
    return same_join(drawn, seen, keys).groupBy(*keys, "first", "second").agg(F.avg(further.cast("double")).alias("p_value")).select(*by, "first", "second", "p_value")


def permuted_quantile_test(df: DataFrame, x: str, first: Column, key: str, n: int = 1000, p: float = 0.5, by: Sequence[str] = (), share: tuple[float, float] | None = None, seed: int = 0) -> DataFrame:
    """(by, delta, p_value): two-sided test of a difference of quantiles by dealing rows anew.

    A replicate deals every row to the first sample or the second, with the share that each has of its group, or
    to neither where `share` takes less of both. The p-value is (further + 1) / (n + 1)."""
    df, keys = _keyed(df, by)
    rows = _two_samples(df, x, first, key, keys)
    seen = _observed(rows, p, keys).select(*keys, F.abs(F.col("first") - F.col("second")).alias("delta"))
    u, all_ = F.col("_u"), F.col("_na") + F.col("_nb")
    a, b = (F.lit(s) for s in share) if share else (F.col("_na") / all_, F.col("_nb") / all_)
    drawn = weighted_quantiles(rows, "x", n, [p], {"a": (u < a).cast("int"), "b": ((u >= a) & (u < a + b)).cast("int") if share else (u >= a).cast("int")}, keys, uniform(seed, "_key", "replicate"))
    side = lambda s: F.max(F.when(F.col("arm") == s, F.col("value")))
    drawn = drawn.groupBy(*keys, "replicate").agg(F.abs(side("a") - side("b")).alias("drawn"))
    further = F.sum((F.col("drawn") > F.col("delta")).cast("int"))
    return same_join(drawn, seen, keys).groupBy(*keys, "delta").agg(((further + 1) / F.lit(n + 1)).alias("p_value")).select(*by, "delta", "p_value")
