"""Results kept by plan: a Parquet store keyed by what a DataFrame computes, and ordered parallel maps."""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; a temporary one is set only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weirflow-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def key_of(name: str, plan: DataFrame, **arguments) -> str:
    """Name, canonical arguments, canonical plan and the state of its input files as one short key.

    Arguments in any order give the same; new or changed files under the same path give another."""
    spark, files = plan.sparkSession, []
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for file in sorted(plan.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(conf).getFileStatus(path)
        files.append((file, status.getLen(), status.getModificationTime()))
    canonical = plan._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    said = json.dumps({"name": name, "args": arguments, "plan": [plan.semanticHash(), canonical], "schema": plan.schema.json(), "files": files}, sort_keys=True, default=str)
    return f"{name}-{hashlib.sha256(said.encode()).hexdigest()[:24]}"


def cached(df: DataFrame, folder: str, name: str, **arguments) -> DataFrame:
    """Read the stored result of this plan, or compute and store it. A store that cannot be read is
    computed anew."""
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{key_of(name, df, **arguments)}"
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallel_map(spark: SparkSession, function: Callable, tasks: Sequence, schema: str) -> DataFrame:
    """(task, error, ...): one row for each task in order of number; a failing one gives its error as text.

    `function` takes a task and returns a tuple of the schema's values. Tasks are a stated list."""
    import pandas as pd

    names = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            rows = []
            for n in batch["task"]:
                try:
                    rows.append((n, None, *function(tasks[n])))
                except Exception as e:  # the error is the result
                    rows.append((n, f"{type(e).__name__}: {e}", *[None] * len(names)))
            yield pd.DataFrame(rows, columns=["task", "error", *names])

    numbered = spark.range(len(tasks)).select(F.col("id").alias("task"))
    return numbered.repartition(max(1, min(len(tasks), 256)), "task").mapInPandas(run, f"task long, error string, {schema}")
