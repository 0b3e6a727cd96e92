import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weirflow.streaming import windows as s


def _stream(spark, folder, data, pieces=1):
    for k, part in enumerate(np.array_split(np.arange(len(data)), pieces)):
        spark.createDataFrame(data.iloc[part]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")


def _greedy(times, least):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= least:
            kept.append(t)
    return kept


def test_thin_sorts_a_unit_beyond_one_arrow_batch(spark, tmp_path):
    times = np.random.default_rng(3).permutation(25000) * 7
    data = pd.DataFrame({"u": np.arange(len(times)) % 2, "t": times})
    made = s.run_once(s.thin(_stream(spark, tmp_path, data), "u", "t", 100), "thin")
    got = made.groupBy("u").agg(F.sort_array(F.collect_list("t")).alias("t")).collect()
    assert {r.u: r.t for r in got} == {u: _greedy(data.loc[data["u"] == u, "t"], 100) for u in (0, 1)}


def test_rows_and_state_are_files_of_the_shared_folder(spark, tmp_path):
    data = pd.DataFrame({"u": [1, 1, 2], "t": [0, 5, 1]})
    made = s.run_once(s.thin(_stream(spark, tmp_path, data), "u", "t", 3), "kept")
    files = made.inputFiles()
    shared = spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert files and all(f.replace("file://", "").startswith(shared) for f in files)
    assert os.path.isdir(files[0].replace("file://", "").rsplit("/", 2)[0] + "/state")
    assert "kept" not in {t.name for t in spark.catalog.listTables()}
