"""Vectors, colours, densities, codes, rank tests and simulated models."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import colour, state as st
from ..operators import coding, density as d, ranktests as rt, scan, vectors as v
from ..operators.kernels import map_series
from ..sources.tables import load, series
from .registry import SERIES, query, r6, r6_up

_E = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


@query(f"SELECT vec_id, round(list_sum(e), 6) + 0.0 AS total, round(list_avg(e), 6) + 0.0 AS mean, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS size, round(list_var_pop(e), 6) AS var, round(list_var_samp(e), 6) AS svar FROM (SELECT vec_id, {_E} AS e FROM embeddings)")
def vector_moments(spark, sf_dir):
    e = F.col("e")
    return _vectors(spark, sf_dir).select("vec_id", r6(v.total(e)).alias("total"), r6(v.mean(e)).alias("mean"), r6(v.magnitude(e)).alias("size"), r6(v.variance(e)).alias("var"), r6(v.variance(e, sample=True)).alias("svar"))


@query(f"WITH e AS (SELECT vec_id, {_E} AS e FROM embeddings) SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(q.e, e.e), 5) + 0.0 AS value FROM e, e q WHERE q.vec_id <> e.vec_id")
def all_pairs_cosine(spark, sf_dir):
    """Every vector against all others."""
    rows = _vectors(spark, sf_dir)
    made = v.query_pairs(rows, "vec_id", "e", rows)
    return made.select("query", "vec_id", (F.round("value", 5) + 0.0).alias("value"))


@query(f"WITH e AS (SELECT vec_id, list_transform(e0, lambda x: x - list_avg(e0)) AS e FROM (SELECT vec_id, {_E} AS e0 FROM embeddings)) SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(q.e, e.e), 5) + 0.0 AS value FROM e, e q WHERE q.vec_id <> e.vec_id")
def all_pairs_corr(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    made = v.query_pairs(rows, "vec_id", "e", rows, "correlation")
    return made.select("query", "vec_id", (F.round("value", 5) + 0.0).alias("value"))


@query(f"WITH m AS (SELECT vec_id AS row, unnest(range(0, 64)) AS col, unnest({_E}) AS value FROM embeddings) SELECT a.col AS row, b.col, round(sum(a.value * b.value), 4) + 0.0 AS value FROM m a JOIN m b ON a.row = b.row GROUP BY ALL")
def matrix_product(spark, sf_dir):
    m = v.to_long(_vectors(spark, sf_dir), "vec_id", "e")
    return v.matmul(v.transpose(m), m).select("row", "col", (F.round("value", 4) + 0.0).alias("value"))


@query(f"WITH m AS (SELECT unnest({_E}) AS value FROM embeddings) SELECT round(sqrt(sum(value * value)), 5) AS norm FROM m")
def matrix_norm(spark, sf_dir):
    return v.frobenius(v.to_long(_vectors(spark, sf_dir), "vec_id", "e")).select(F.round("norm", 5).alias("norm"))


@query()
def array_helpers(spark, sf_dir):
    e = F.col("e")
    return _vectors(spark, sf_dir).select("vec_id", v.box_sum(e, 3).alias("box"), v.padded(e, 70).alias("padded"), v.edges(e).alias("edges"), v.centres(v.edges(e)).alias("centres"), v.nondecreasing(e).alias("rising"), v.onehot(F.col("vec_id") % 4, 4).alias("onehot"), v.zscored(e).alias("z"))


@query("SELECT event_id, '#' || lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0') AS code, round(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b, 4) AS light, CAST(((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3) AS BIGINT) AS packed, CAST((r << 16) | (g << 8) | b AS BIGINT) AS wide FROM (SELECT event_id, event_id % 256 AS r, (event_id * 7) % 256 AS g, user_id % 256 AS b FROM events)")
def colour_codes(spark, sf_dir):
    r, g, b = F.col("event_id") % 256, (F.col("event_id") * 7) % 256, F.col("user_id") % 256
    code = F.lower(colour.rgb_hex(r, g, b))
    return load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("#"), F.upper(F.substring(code, 2, 6))).alias("code"), F.round(colour.lightness(r, g, b), 4).alias("light"), colour.pack16(r, g, b).alias("packed"), colour.pack24(r, g, b).alias("wide"))


@query()
def kernel_density(spark, sf_dir):
    return d.kde(load(spark, sf_dir, "events"), "value", [float(x) for x in range(0, 205, 5)], "event_type")


@query()
def density_mode(spark, sf_dir):
    return d.mode(d.kde(load(spark, sf_dir, "events"), "value", [float(x) for x in range(0, 205, 5)], "event_type"), "event_type")


@query("WITH f AS (SELECT event_id, user_id, max(value) OVER w - min(value) OVER w AS width, count(*) OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT event_id, round((k - 1) / nullif(width, 0) / n, 6) AS density FROM f")
def knn_density(spark, sf_dir):
    return d.knn_density(load(spark, sf_dir, "events"), "value", "user_id", "event_id", 5).select("event_id", r6("density").alias("density"))


@query()
def bimodal_fit(spark, sf_dir):
    found = d.hard_mixture(load(spark, sf_dir, "events").select(F.log("value").alias("x")), "x", 2)
    return spark.createDataFrame([tuple(map(float, f)) for f in found], "mean double, sd double, share double")


@query("SELECT user_id, round(sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 6) AS mean, CAST(sum(event_id % 5 + 1) AS BIGINT) AS precision FROM events GROUP BY user_id")
def fused_gaussians(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("t", F.col("event_id") % 5 + 1)
    return d.fuse(rows, "value", "t", ["user_id"]).select("user_id", r6("mean").alias("mean"), "precision")


@query()
def huffman_codes(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    return coding.encode(rows, "event_type", "user_id", "event_id", coding.code_table(rows, "event_type"))


_U = """WITH t AS (SELECT user_id % 4 AS k, value AS x, count(*) AS t, sum(CAST(event_type = 'click' AS INT)) AS a FROM events GROUP BY ALL),
    r AS (SELECT *, sum(t) OVER (PARTITION BY k ORDER BY x) - (t - 1) / 2.0 AS rank FROM t)"""


@query(_U + ", s AS (SELECT k, sum(rank * a) AS r, sum(a) AS n1, sum(t - a) AS n2, sum(t * t * t - t) AS ties FROM r GROUP BY k) SELECT k, round(CAST(r - n1 * (n1 + 1) / 2.0 AS DOUBLE), 3) AS u, round((r - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 5) + 0.0 AS z FROM s")
def mann_whitney(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("k", F.col("user_id") % 4)
    return rt.mann_whitney(rows, "value", F.col("event_type") == "click", "k").select("k", F.round("u", 3).alias("u"), (F.round("z", 5) + 0.0).alias("z"))


@query("WITH x AS (SELECT user_id % 4 AS k, value - 50 AS d FROM events WHERE value <> 50), t AS (SELECT k, abs(d) AS x, count(*) AS t, sum(CAST(d > 0 AS INT)) AS a FROM x GROUP BY ALL), r AS (SELECT *, sum(t) OVER (PARTITION BY k ORDER BY x) - (t - 1) / 2.0 AS rank FROM t), s AS (SELECT k, sum(rank * a) AS w, sum(t) AS n, sum(t * t * t - t) AS ties FROM r GROUP BY k) SELECT k, round(CAST(w AS DOUBLE), 3) AS w, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 5) + 0.0 AS z FROM s")
def wilcoxon(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("k"), (F.col("value") - 50).alias("d"))
    return rt.wilcoxon(rows, "d", "k").select("k", F.round("w", 3).alias("w"), (F.round("z", 5) + 0.0).alias("z"))


@query()
def ztest_by_type(spark, sf_dir):
    m = load(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("s"))
    z, p = rt.ztest(F.col("m"), F.col("s"), F.lit(50.0), F.lit(0.0))
    return m.select("event_type", r6(z).alias("z"), r6(p).alias("p"))


@query()
def relaxing_paths(spark, sf_dir):
    """Ornstein-Uhlenbeck paths, one for each user, seeded by it."""
    rows = series(load(spark, sf_dir, "events"))

    def kernel(x):
        return {"t": np.arange(len(x)), "x": st.ornstein_uhlenbeck(0.0, 1.0, 10.0, 0.1, len(x), len(x))}

    return map_series(rows, "user_id", "i", "value", kernel, "t long, x double", least=1)


@query(
    f"""{SERIES} SELECT a.user_id, a.i, round(sum(b.value * 0.5 * pow(0.5, a.i - b.i)) + 3e-10, 6) AS fast, round(sum(b.value * (pow(0.8, a.i - b.i) + 0.05 * (pow(0.8, a.i - b.i) - pow(0.5, a.i - b.i)) / 0.3)) + 3e-10, 6) AS slow FROM s a JOIN s b ON b.user_id = a.user_id AND b.i <= a.i GROUP BY a.user_id, a.i"""
)
def state_space_filter(spark, sf_dir):
    a, c = np.array([[-0.2, 0.1], [0.0, -0.5]]), np.array([1.0, 0.5])
    made = scan.linear_filter(series(load(spark, sf_dir, "events")), "user_id", "i", "value", a, c, np.zeros(2))
    return made.select("user_id", "i", r6_up(F.col("z")[1]).alias("fast"), r6_up(F.col("z")[0]).alias("slow"))
