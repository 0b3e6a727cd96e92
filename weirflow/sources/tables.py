"""Loading tables, and the views of them that queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of float columns as null, so that aggregates pass over it."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def seconds(ts: str) -> Column:
    return micros(ts) / F.lit(1e6)


def series(events: DataFrame, value: str = "value") -> DataFrame:
    """events as sampled series: user_id, i (from 0, in order of time and event_id), value."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("user_id", "event_id", "event_type", "ts", (F.row_number().over(order) - 1).cast("long").alias("i"), F.col(value).alias("value"))
