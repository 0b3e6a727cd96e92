"""Sources, the plan-keyed store and parallel maps."""

import math

from pyspark.sql import functions as F

from ..plans.store import cached, checkpoint_folder, parallel_map
from ..sources.tables import load, nan_to_null
from .registry import query


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag")
def cached_summary(spark, sf_dir):
    made = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return cached(made, checkpoint_folder(spark), "summary", by="l_returnflag")


@query()
def parallel_roots(spark, sf_dir):
    return parallel_map(spark, lambda v: (math.sqrt(v),), [4.0, 9.0, -1.0, 16.0], "root double")


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events")
def nan_as_null(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return nan_to_null(rows)


@query("SELECT c_custkey, c_nationkey, coalesce(n_name, 'none') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def lookup_with_default(spark, sf_dir):
    names = load(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", "n_name")
    joined = load(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", "c_nationkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


@query("SELECT user_id AS key, event_type AS a, NULL AS b FROM events WHERE value > 200 UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer WHERE c_acctbal < 0")
def vertical_concat(spark, sf_dir):
    a = load(spark, sf_dir, "events").where("value > 200").select(F.col("user_id").alias("key"), F.col("event_type").alias("a"))
    b = load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("b"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT l_returnflag, mode(l_linestatus) AS status, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def mode_by_flag(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.mode("l_linestatus").alias("status"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def all_marginals(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
