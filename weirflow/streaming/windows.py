"""Streaming forms: block statistics, sliding means, sessions, greedy thinning."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.store import checkpoint_folder


def block_stats(events: DataFrame, width: str, late: str, slide: str | None = None, by: str | None = None) -> DataFrame:
    """Count, mean and population variance of value by window; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    made = events.withWatermark("ts", late).groupBy(window.alias("w"), *([by] if by else [])).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    return made.select(F.col("w.start").alias("start"), *([by] if by else []), "n", "mean", "var")


def sessions(events: DataFrame, gap: str, late: str, by: str) -> DataFrame:
    """Pieces of a unit's events that gaps of time part."""
    made = events.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def thin(events: DataFrame, by: str, t: str, least: int) -> DataFrame:
    """Greedy thinning with the last kept time of each unit as state; t is a long. Rows of a batch are
    taken in order of time, for which a unit's times in it are held at once."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, keep = state.get[0] if state.exists else None, []
        for now in np.sort(np.concatenate([rows[t].to_numpy() for rows in batches])).tolist():
            if last is None or now - last >= least:
                keep.append(now)
                last = now
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({by: [key[0]] * len(keep), t: np.array(keep, np.int64)})

    kinds = dict(events.dtypes)
    return events.select(by, t).groupBy(by).applyInPandasWithState(step, f"{by} {kinds[by]}, {t} long", "last long", "append", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and return its rows as a table; for tests and backfills.

    Rows are files in the shared checkpoint folder, written by the tasks, and so is the stream's state; only the windows of
    `complete` mode, which are written anew with every batch, are held by the driver. State is kept by RocksDB, so that
    an executor's memory doesn't bound it."""
    spark = df.sparkSession
    at = f"{checkpoint_folder(spark).rstrip('/')}/{name}_{uuid.uuid4().hex[:8]}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    out = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    out = out.format("parquet").option("path", f"{at}/rows") if mode == "append" else out.format("memory")
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = out.start()
    finally:
        spark.conf.set(provider, before)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows") if mode == "append" else spark.table(name)
