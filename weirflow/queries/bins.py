"""Histograms and binned statistics."""

from pyspark.sql import functions as F

from ..operators import binning as b
from ..sources.tables import load
from .registry import query, r6

_U = "CASE WHEN l_quantity BETWEEN 5 AND 45 THEN least(CAST(floor((l_quantity - 5) * 8 / 40.0) AS BIGINT), 7) END"


def _items(spark, sf_dir):
    return load(spark, sf_dir, "lineitem")


@query(f"WITH c AS (SELECT {_U} AS bin FROM lineitem), n AS (SELECT h.bin, count(c.bin) AS n FROM (SELECT unnest(range(0, 8)) AS bin) h LEFT JOIN c USING (bin) GROUP BY h.bin) SELECT bin, n, round(n / sum(n) OVER (), 6) AS share FROM n")
def hist_uniform(spark, sf_dir):
    return b.histogram(_items(spark, sf_dir), "l_quantity", 5, 45, 8).select("bin", "n", r6("share").alias("share"))


@query("WITH c AS (SELECT greatest(least(CAST(floor((l_quantity - 5) * 8 / 40.0) AS BIGINT), 7), 0) AS bin FROM lineitem), n AS (SELECT h.bin, count(c.bin) AS n FROM (SELECT unnest(range(0, 8)) AS bin) h LEFT JOIN c USING (bin) GROUP BY h.bin) SELECT bin, n, round(n / sum(n) OVER (), 6) AS share FROM n")
def hist_clamped(spark, sf_dir):
    return b.histogram(_items(spark, sf_dir), "l_quantity", 5, 45, 8, clamp=True).select("bin", "n", r6("share").alias("share"))


@query("SELECT CAST(floor(l_tax / 0.025) AS BIGINT) AS row, CAST(floor((l_discount + 0.0) / 0.025) AS BIGINT) AS col, count(*) AS n FROM lineitem GROUP BY ALL")
def hist_grid(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("d", F.col("l_discount") + 0.0)
    return b.grid_histogram(rows, "d", "l_tax", 0.025)


@query(
    """WITH p AS (SELECT greatest(0, least(l_quantity / 50 * 9, 9 - 1e-9)) AS x, greatest(0, least(l_discount * 10 * 9, 9 - 1e-9)) AS y FROM lineitem),
    q AS (SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, x - floor(x) AS fx, y - floor(y) AS fy FROM p),
    c AS (SELECT iy + a AS row, ix + b AS col, (CASE WHEN a = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN b = 1 THEN fx ELSE 1 - fx END) AS s FROM q, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
    SELECT row, col, round(sum(s), 4) + 0.0 AS total FROM c GROUP BY row, col HAVING round(sum(s), 4) <> 0"""
)
def hist2d_bilinear(spark, sf_dir):
    rows = _items(spark, sf_dir).select((F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("y"))
    return b.bilinear_histogram(rows, "x", "y", 10).select("row", "col", (F.round("total", 4) + 0.0).alias("total")).where("total != 0")


_S = "round(avg(y), 4) AS mean, round(median(y), 4) AS median, round(stddev_pop(y), 4) AS sd, count(y) AS n, round(stddev_pop(y) / sqrt(count(y)), 4) AS sem, round(quantile_cont(y, 0.05), 4) AS low, round(quantile_cont(y, 0.95), 4) AS high"


def _rounded(made):
    return made.select("bin", *(F.round(c, 4).alias(c) if c != "n" else F.col("n") for c in made.columns[1:]))


@query(f"SELECT bin, {_S} FROM (SELECT {_U} AS bin, l_extendedprice AS y FROM lineitem) WHERE bin IS NOT NULL GROUP BY bin")
def binned_statistics(spark, sf_dir):
    return _rounded(b.binned_stats(_items(spark, sf_dir), b.uniform_bin(F.col("l_quantity"), 5, 45, 8), "l_extendedprice"))


@query(
    f"""WITH e AS (SELECT {", ".join(f"quantile_cont(value, {k / 5}) AS e{k}" for k in range(6))} FROM events)
    SELECT bin, {_S} FROM (SELECT CAST(CASE WHEN value = e5 THEN 4 {" ".join(f"WHEN value >= e{k} AND value < e{k + 1} THEN {k}" for k in range(5))} END AS BIGINT) AS bin, epoch_us(ts) % 86400000000 / 3600e6 AS y FROM events, e) WHERE bin IS NOT NULL GROUP BY bin"""
)
def pike_percentile(spark, sf_dir):
    from ..sources.tables import micros

    rows = load(spark, sf_dir, "events").withColumn("h", micros("ts") % 86400000000 / 3600e6)
    return _rounded(b.pike(rows, "value", "h", 5))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY l_returnflag")
def trendline_by_flag(spark, sf_dir):
    made = b.trendline(_items(spark, sf_dir), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return made.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))
