"""Vectors of a stated query set against all, by blocks, over more than one block each way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.operators import vectors as v
from weirflow.queries import QUERIES


@pytest.mark.parametrize("measure", ["cosine", "correlation", "rms"])
def test_pairs_by_blocks(spark, measure):
    m = np.random.default_rng(2).normal(size=(1100, 5))
    m[700] = m[3]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "k long, e array<double>").coalesce(1)
    asked = rows.where("k < 600 and k % 3 = 0")
    made = v.time_distances(rows, "k", "e", asked) if measure == "rms" else v.query_pairs(rows, "k", "e", asked, measure)
    other = "t" if measure == "rms" else "k"
    got = {(r["query"], r[other]): r["value"] for r in made.collect()}
    assert len(got) == 200 * (1100 if measure == "rms" else 1099) == made.count()
    c = m - m.mean(axis=1, keepdims=True) if measure == "correlation" else m
    for q, k in list(got)[::97] + [(3, 700)]:
        want = np.sqrt(((m[q] - m[k]) ** 2).mean()) if measure == "rms" else c[q] @ c[k] / np.linalg.norm(c[q]) / np.linalg.norm(c[k])
        assert got[q, k] == pytest.approx(want, abs=1e-12)
    assert measure != "rms" or got[3, 700] == got[3, 3] == 0


def test_vectors_do_not_grow_by_element(spark):
    """No row for an element: what is shuffled are blocks, and a pair is made once."""
    rows = spark.range(200).select("id", F.array_repeat(F.col("id").cast("double"), 8).alias("e"))
    plan = v.time_distances(rows, "id", "e", rows.where("id < 4"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("name", ["all_pairs_cosine", "all_pairs_corr", "time_distances"])
def test_queries_compare_every_vector_with_all(spark, name, tmp_path):
    """Also more than one block of them, whatever their ids."""
    n = 530
    rows = spark.range(n).select((F.col("id") * 50 + 7).alias("vec_id"), F.array(*(F.sin(F.col("id") * k).cast("float") for k in (1, 2, 3, 5))).alias("embedding"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES[name](spark, str(tmp_path)).groupBy("query").count().collect()
    assert len(found) == n and {r["count"] for r in found} == {n if name == "time_distances" else n - 1}
