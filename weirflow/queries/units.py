"""Event streams: lags, triggered averages, rasters, intervals between events."""

from pyspark.sql import functions as F

from ..operators import events as e
from ..plans.joins import band_join
from ..sources.tables import load, micros, seconds, series
from .registry import SERIES, query, r6


def _times(spark, sf_dir, suffix):
    rows = load(spark, sf_dir, "events")
    return rows.select("user_id", F.col("event_id").alias(f"id{suffix}"), F.col("event_type").alias(f"type{suffix}"), (micros("ts") / 1e6).alias(f"t{suffix}"), F.col("value").alias(f"value{suffix}"))


@query("SELECT CAST(floor((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 / 3600) AS BIGINT) AS bin, round(avg(b.value), 6) AS mean, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type <> 'error' AND (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 >= -43200 AND (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 < 43200 WHERE a.event_type = 'error' GROUP BY 1")
def peri_event_average(spark, sf_dir):
    """Average of a user's other events around each error, by hour of lag."""
    left, right = _times(spark, sf_dir, "a").where("typea = 'error'"), _times(spark, sf_dir, "b").where("typeb != 'error'")
    pairs = band_join(left, right, "ta", "tb", -43200, 43200, ["user_id"])
    return pairs.groupBy(F.floor((F.col("tb") - F.col("ta")) / 3600).cast("long").alias("bin")).agg(r6(F.avg("valueb")).alias("mean"), F.count("*").alias("n"))


@query("SELECT CAST(floor((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 / 60) AS BIGINT) AS bin, count(*) AS n FROM events a JOIN events b ON epoch_us(b.ts) - epoch_us(a.ts) >= -600000000 AND epoch_us(b.ts) - epoch_us(a.ts) < 600000000 AND b.event_type = 'purchase' WHERE a.event_type = 'click' GROUP BY 1")
def cross_correlogram(spark, sf_dir):
    left, right = _times(spark, sf_dir, "a").where("typea = 'click'").drop("user_id"), _times(spark, sf_dir, "b").where("typeb = 'purchase'").drop("user_id")
    return e.correlogram(e.pairwise_lags(left, right, "ta", "tb", 300), F.col("tb") - F.col("ta"), 60)


@query(f"{SERIES}, z AS (SELECT user_id, max(i) AS z FROM s GROUP BY user_id), p AS (SELECT b.i - a.i AS lag, b.value FROM s a JOIN z USING (user_id) JOIN s b ON a.user_id = b.user_id AND b.i - a.i BETWEEN -4 AND 4 WHERE a.event_type = 'error' AND a.i - 4 > 0 AND a.i + 4 < z) SELECT lag, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, count(value) AS n, round(1.96 * stddev_pop(value) / sqrt(count(value)), 6) AS sem95 FROM p GROUP BY lag")
def triggered_stats(spark, sf_dir):
    rows = series(load(spark, sf_dir, "events"))
    made = e.triggered_stats(e.snippets(rows.select("user_id", "i", "value"), rows.where("event_type = 'error'"), "user_id", "i", 4))
    return made.select("lag", r6("mean").alias("mean"), r6("sd").alias("sd"), "n", r6("sem95").alias("sem95"))


@query(f"{SERIES} SELECT user_id, CAST(floor(i / 7) AS BIGINT) AS bin, CAST(sum(CAST(value > 50 AS BIGINT)) AS BIGINT) AS total FROM s GROUP BY ALL")
def cut_bins(spark, sf_dir):
    rows = series(load(spark, sf_dir, "events")).withColumn("on_", (F.col("value") > 50).cast("long"))
    return e.cut(rows, "user_id", "i", "on_", 7)


@query("SELECT h.t, CASE WHEN e.t IS NULL THEN 0 ELSE 1 END AS spike FROM (SELECT unnest(range(0, 720)) AS t) h LEFT JOIN (SELECT DISTINCT CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600e6) AS BIGINT) AS t FROM events WHERE event_type = 'error') e USING (t)")
def raster(spark, sf_dir):
    hours = (micros("ts") - 1704067200000000) / 3600e6
    rows = load(spark, sf_dir, "events").where("event_type = 'error'").select(hours.alias("t"))
    return e.raster(rows, "t", 720)


@query("WITH x AS (SELECT CAST(least(floor(value / 25), (SELECT ceil(max(value) / 25) FROM events) - 1) AS BIGINT) AS bin FROM events) SELECT b.bin, count(x.bin) AS n FROM (SELECT unnest(range(0, (SELECT CAST(ceil(max(value) / 25) AS BIGINT) FROM events))) AS bin) b LEFT JOIN x ON x.bin = b.bin GROUP BY b.bin")
def bin_times(spark, sf_dir):
    return e.bin_times(load(spark, sf_dir, "events"), "value", 25.0)


@query("SELECT CAST(floor(isi / 3600) AS BIGINT) AS bin, count(*) AS n FROM (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS isi FROM events) WHERE isi IS NOT NULL GROUP BY 1")
def isi_histogram(spark, sf_dir):
    rows = e.intervals(load(spark, sf_dir, "events").withColumn("t", seconds("ts")), "user_id", "t", "event_id")
    rows = rows.where("isi is not null").withColumn("isi", F.round("isi", 6))
    return rows.groupBy(F.floor(F.col("isi") / 3600).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query()
def thinned_events(spark, sf_dir):
    """Events at least six hours after the last kept one of their user."""
    rows = load(spark, sf_dir, "events").withColumn("t", micros("ts"))
    return e.thin(rows, "user_id", "t", "event_id", 6 * 3600 * 1000000).select("user_id", "event_id")


@query(f"{SERIES}, f AS (SELECT user_id, i, CAST(event_type = 'click' AS DOUBLE) AS a, value AS b FROM s), m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM f) SELECT y.i - x.i AS lag, round(sum((x.a - ma) * (y.b - mb)), 3) + 0.0 AS total FROM f x JOIN f y ON x.user_id = y.user_id AND y.i - x.i BETWEEN -3 AND 3, m GROUP BY 1")
def lag_products(spark, sf_dir):
    rows = series(load(spark, sf_dir, "events")).withColumn("a", (F.col("event_type") == "click").cast("double"))
    return e.lag_products(rows, "user_id", "i", "a", "value", 3).select("lag", (F.round("total", 3) + 0.0).alias("total"))


@query()
def waveform_shapes(spark, sf_dir):
    wave = F.transform("embedding", lambda v: v.cast("double"))
    return load(spark, sf_dir, "embeddings").select("vec_id", e.peak_valley(wave).alias("pvt"), r6(e.pre_peak_ratio(wave)).alias("php"), (F.array_position(e.realign(wave), F.array_min(wave)) - 1).alias("centre"))
