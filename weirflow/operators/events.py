"""Event-stream operators: lags, averages around events, rasters, counts, intervals between events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.joins import band_join, spine


def pairwise_lags(left: DataFrame, right: DataFrame, t_left: str, t_right: str, max_lag: float, factor: float = 2.0, on: Sequence[str] = ()) -> DataFrame:
    """All pairs whose lag lies in [-factor max_lag, factor max_lag)."""
    return band_join(left, right, t_left, t_right, -factor * max_lag, factor * max_lag, on)


def correlogram(pairs: DataFrame, lag: Column, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts of lags in bins of `width`; bin b holds [b width, (b + 1) width)."""
    return pairs.groupBy(*by, F.floor(lag / F.lit(width)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def snippets(samples: DataFrame, triggers: DataFrame, by: str, i: str, half: int) -> DataFrame:
    """Samples at most `half` from a trigger as (by, trigger, lag, value); triggers whose stretch would
    reach an end of the series are left out, as strictly as the edges themselves.

    `triggers` are (by, i). Every trigger posts its places: an equi-join on the sample's place."""
    bounds = samples.groupBy(by).agg(F.min(i).alias("_low"), F.max(i).alias("_high"))
    inside = triggers.select(by, F.col(i).alias("trigger")).join(bounds, by).where((F.col("trigger") - half > F.col("_low")) & (F.col("trigger") + half < F.col("_high")))
    looking = inside.select(by, "trigger", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("lag")).withColumn(i, F.col("trigger") + F.col("lag"))
    return looking.join(samples, [by, i]).select(by, "trigger", F.col("lag").cast("long").alias("lag"), "value")


def triggered_stats(snips: DataFrame) -> DataFrame:
    """Mean, population deviation, 1.96 standard errors (of kept snippets) and count by lag."""
    made = snips.groupBy("lag").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n"))
    return made.withColumn("sem95", 1.96 * F.col("sd") / F.sqrt("n"))


def cut(df: DataFrame, by: str, i: str, x: str, width: int) -> DataFrame:
    """Sums of a raster in bins of `width` samples, the last one in part."""
    return df.groupBy(by, F.floor(F.col(i) / F.lit(width)).cast("long").alias("bin")).agg(F.sum(x).alias("total"))


def raster(times: DataFrame, t: str, duration: int) -> DataFrame:
    """(t, spike) for every whole time below `duration`, 1 where an event falls on it."""
    hit = times.select(F.floor(t).cast("long").alias("t")).distinct().withColumn("spike", F.lit(1))
    return spine(hit, "t", 0, duration, {"spike": 0})


def bin_times(times: DataFrame, t: str, width: float) -> DataFrame:
    """Counts in ceil(max / width) bins of (bin, n), empty ones too; the last bin holds its right end."""
    top = times.agg(F.max(t)).first()[0]
    bins = 0 if top is None else max(1, int(-(-top // width)))
    at = F.least(F.floor(F.col(t) / F.lit(width)), F.lit(bins - 1)).cast("long")
    return spine(times.where(F.col(t) >= 0).groupBy(at.alias("bin")).agg(F.count("*").alias("n")), "bin", 0, bins, {"n": 0})


def intervals(df: DataFrame, by: str, t: str, tie: str) -> DataFrame:
    """Add isi, the time since the event before of the same unit."""
    return df.withColumn("isi", F.col(t) - F.lag(t).over(Window.partitionBy(by).orderBy(t, tie)))


def thin(df: DataFrame, by: str, t: str, tie: str, least: float) -> DataFrame:
    """Keep an event if it comes at least `least` after the last kept one of its unit.

    Greedy and sequential within a unit: Arrow batches of each unit's sorted times stream through, the
    last kept time being the only state; a unit's rows lie in one task but are never held together."""
    import pyarrow as pa

    order = [by, t, tie]
    kinds = df.select(*order).schema

    def run(batches):
        unit, last = object(), None
        for batch in batches:
            keep = []
            for u, now in zip(batch.column(by).to_pylist(), batch.column(t).to_pylist(), strict=True):
                if u != unit:
                    unit, last = u, None
                keep.append(last is None or now - last >= least)
                last = now if keep[-1] else last
            yield batch.filter(pa.array(keep))

    return df.select(*order).repartition(by).sortWithinPartitions(*order).mapInArrow(run, kinds)


def lag_products(trains: DataFrame, by: str, i: str, a: str, b: str, lags: int) -> DataFrame:
    """(lag, total) of a[i] b[i + lag] summed over series, both centred over all samples."""
    mean = trains.agg(F.avg(a), F.avg(b)).first()
    rows = trains.select(by, i, (F.col(a) - F.lit(mean[0])).alias("_a"), (F.col(b) - F.lit(mean[1])).alias("_b"))
    looking = rows.select(by, "_a", F.col(i), F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag")).withColumn("_j", F.col(i) + F.col("lag"))
    met = looking.join(rows.select(by, F.col(i).alias("_j"), "_b"), [by, "_j"])
    return met.groupBy(F.col("lag").cast("long").alias("lag")).agg(F.sum(F.col("_a") * F.col("_b")).alias("total"))


def realign(wave: Column) -> Column:
    """A waveform array shifted so that its least value is in the middle, zeros where nothing is left."""
    n = F.size(wave)
    shift = F.array_position(wave, F.array_min(wave)).cast("int") - 1 - F.floor(n / 2).cast("int")
    zeros = lambda k: F.array_repeat(F.lit(0.0), F.greatest(k, F.lit(0)))
    return F.slice(F.concat(zeros(-shift), wave, zeros(shift)), F.greatest(shift, F.lit(0)) + 1, n)


def peak_valley(wave: Column) -> Column:
    """Samples from the trough to the largest value after it."""
    trough = F.array_position(wave, F.array_min(wave)).cast("int")
    after = F.slice(wave, trough, F.size(wave))
    return F.array_position(after, F.array_max(after)) - 1


def pre_peak_ratio(wave: Column) -> Column:
    """Height of the peak before the trough over the trough."""
    before = F.slice(wave, F.lit(1), F.array_position(wave, F.array_min(wave)).cast("int"))
    return F.array_max(before) / F.array_min(wave)
