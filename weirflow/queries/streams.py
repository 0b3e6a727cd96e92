"""Streaming queries, run over a table as a stream."""

import uuid

from pyspark.sql import functions as F

from ..sources.tables import load
from ..streaming import windows as s
from .registry import query


def _stream(spark, sf_dir):
    # braces make the path a pattern, which may stand for one file or for a folder of them
    schema = load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{{events.parquet}}}}").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 6) + 0.0 AS \"var\" FROM events GROUP BY 1")
def stream_block_stats(spark, sf_dir):
    made = s.run_once(s.block_stats(_stream(spark, sf_dir), "1 hour", "1 day"), f"blocks_{uuid.uuid4().hex[:8]}", "complete")
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"), (F.round("var", 6) + 0.0).alias("var"))


@query()
def stream_sessions(spark, sf_dir):
    return s.run_once(s.sessions(_stream(spark, sf_dir), "6 hours", "1 day", "user_id"), f"sessions_{uuid.uuid4().hex[:8]}")


@query()
def stream_thinned(spark, sf_dir):
    from ..sources.tables import micros

    rows = _stream(spark, sf_dir).withColumn("t", micros("CAST(ts AS TIMESTAMP_NTZ)"))
    return s.run_once(s.thin(rows, "user_id", "t", 6 * 3600 * 1000000), f"thin_{uuid.uuid4().hex[:8]}")
