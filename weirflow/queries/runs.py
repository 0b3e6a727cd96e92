"""Binary series, gaps and pieces."""

from pyspark.sql import functions as F

from ..operators import intervals as v
from ..sources.tables import load, series
from .registry import SERIES, query, r6

BY, I = "user_id", "i"
_O = "PARTITION BY user_id ORDER BY i"
_FLAGS = f"{SERIES}, f AS (SELECT *, value > 30 AS on_ FROM s)"
_RUNS = _FLAGS + f""", t AS (SELECT *, coalesce(CAST(on_ <> lag(on_) OVER ({_O}) AS INT), 0) AS turn FROM f),
    g AS (SELECT *, sum(turn) OVER ({_O}) AS run FROM t), r AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS len FROM g)"""


def flags(spark, sf_dir):
    return series(load(spark, sf_dir, "events")).withColumn("on_", F.col("value") > 30)


@query(_RUNS + " SELECT user_id, min(i) AS start, max(i) + 1 AS stop FROM r WHERE on_ GROUP BY user_id, run")
def run_edges(spark, sf_dir):
    return v.get_edges(flags(spark, sf_dir), "on_", BY, I)


@query(_RUNS + ", z AS (SELECT user_id, max(i) AS z FROM s GROUP BY user_id) SELECT user_id, start, stop FROM (SELECT user_id, min(i) AS start, max(i) + 1 AS stop FROM r WHERE on_ GROUP BY user_id, run) JOIN z USING (user_id) WHERE start > 0 AND stop <= z")
def run_edges_whole(spark, sf_dir):
    return v.get_edges(flags(spark, sf_dir), "on_", BY, I, pad=False)


@query(_FLAGS + " SELECT user_id, i, on_ AS flag FROM f")
def edges_round_trip(spark, sf_dir):
    rows = flags(spark, sf_dir)
    lengths = rows.groupBy(BY).agg(F.count("*").alias("n"))
    return v.set_edges(v.get_edges(rows, "on_", BY, I), lengths, BY)


@query(_RUNS + " SELECT user_id, i, on_ OR len <= 2 AS y FROM r")
def remove_gaps(spark, sf_dir):
    return v.remove_gaps(flags(spark, sf_dir), "on_", BY, I, 2, "y").select(BY, I, "y")


@query(_RUNS + " SELECT user_id, i, on_ AND len > 2 AS y FROM r")
def remove_short(spark, sf_dir):
    return v.remove_short(flags(spark, sf_dir), "on_", BY, I, 2, "y").select(BY, I, "y")


@query(_FLAGS + f" SELECT user_id, i, max(on_) OVER ({_O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS wide, min(on_) OVER ({_O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS safe, max(on_) OVER ({_O} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS legacy FROM f")
def dilate_and_erode(spark, sf_dir):
    return flags(spark, sf_dir).select(BY, I, v.dilate("on_", BY, I, 3).alias("wide"), v.erode("on_", BY, I, 3).alias("safe"), v.dilate("on_", BY, I, 3, legacy=True).alias("legacy"))


@query(f"{SERIES}, p AS (SELECT user_id, i, value, sum(coalesce(CAST(st AS INT), 0)) OVER ({_O}) AS piece FROM (SELECT *, abs(value - lag(value) OVER ({_O})) > 40 AS st FROM s)) SELECT user_id, CAST(piece AS BIGINT) AS piece, count(*) AS n, min(i) AS start, round(avg(value), 6) AS mean FROM p GROUP BY user_id, piece")
def split_pieces(spark, sf_dir):
    rows = v.split_pieces(series(load(spark, sf_dir, "events")), "value", BY, I, 40.0)
    return rows.groupBy(BY, "piece").agg(F.count("*").alias("n"), F.min("i").alias("start"), r6(F.avg("value")).alias("mean"))


_MASKED = SERIES.replace("event_type, ts,", "event_type, ts,").replace("- 1 AS i, value FROM", "- 1 AS i, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 1 THEN value END AS value FROM")


def _fill_sql(share: str) -> str:
    return (
        _MASKED
        + f""", a AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ai, last_value(value IGNORE NULLS) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS av,
    first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER ({_O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bi, first_value(value IGNORE NULLS) OVER ({_O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bv FROM s)
    SELECT user_id, i, round(coalesce(value, av + (bv - av) * {share}), 6) AS y FROM a"""
    )


def _fill(spark, sf_dir, legacy):
    keep = (F.col("event_id") % 7 != 0) & (F.col("event_id") % 5 != 1)
    rows = series(load(spark, sf_dir, "events")).withColumn("value", F.when(keep, F.col("value")))
    return v.interpolate_gaps(rows, "value", BY, I, "y", legacy).select(BY, I, r6("y").alias("y"))


@query(_fill_sql("(i - ai) * 1.0 / nullif(bi - ai, 0)"))
def nan_interpolate(spark, sf_dir):
    return _fill(spark, sf_dir, False)


@query(_fill_sql("(i - ai - 1) * 1.0 / nullif(bi - ai - 1, 0)"))
def nan_interpolate_legacy(spark, sf_dir):
    return _fill(spark, sf_dir, True)


@query("SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(coalesce(CAST(gap AS INT), 0)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS gap FROM events)) GROUP BY user_id, k")
def pieces_session(spark, sf_dir):
    rows = load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")
