"""Factor analysis, splines, robust lines and non-linear fits."""


from pyspark.sql import functions as F

from ..operators import curves, factors
from ..sources.tables import load, seconds
from .chance import _u, _unit
from .registry import query, r6
from .values import _ANGLE, angles


@query("SELECT i - 1 AS i, j - 1 AS j, round(covar_pop(embedding[i]::DOUBLE, embedding[j]::DOUBLE), 6) + 0.0 AS covariance FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY i, j")
def vector_covariance(spark, sf_dir):
    """All pairs of features of the vectors, from one pass."""
    _, _, cov = factors.vector_moments(load(spark, sf_dir, "embeddings"), "embedding")
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(rows, "i long, j long, covariance double").withColumn("covariance", r6("covariance"))


@query("SELECT i - 1 AS feature, round(var_pop(embedding[i]::DOUBLE), 4) AS variance FROM embeddings, range(1, 65) a(i) GROUP BY i")
def factor_variances(spark, sf_dir):
    """What four factors and the noise explain of each feature: at the likelihood's peak, its whole variance."""
    model = factors.factor_analysis(load(spark, sf_dir, "embeddings"), "embedding", 4)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.covariance().diagonal())], "feature long, variance double").withColumn("variance", F.round("variance", 4))


@query()
def factor_scores(spark, sf_dir):
    """Means of four latent factors for every vector, and two features predicted from the others."""
    rows = load(spark, sf_dir, "embeddings")
    model = factors.factor_analysis(rows, "embedding", 4)
    return rows.select("vec_id", factors.project(model, "embedding").alias("factors"), factors.predict(model, "embedding", range(2, 64), (0, 1)).alias("predicted"))


_LINES = "count(*) FILTER (w > 0) AS rows_used, sum(w) AS n, sum(w * x) AS a, sum(w * y) AS b, sum(w * x * x) AS aa, sum(w * x * y) AS ab"


@query(
    f"WITH d AS (SELECT r, hour(ts) + 0.0 AS x, value AS y, CASE WHEN r < 0 THEN 1 ELSE {_unit(_u('event_id'))} END + 0.0 AS w FROM events, range(-1, 30) t(r)), s AS (SELECT r, {_LINES} FROM d GROUP BY r)"
    " SELECT CAST(r AS INTEGER) AS replicate, round((n * ab - a * b) / (n * aa - a * a), 6) + 0.0 AS slope, round((b - (n * ab - a * b) / (n * aa - a * a) * a) / n, 6) + 0.0 AS intercept FROM s"
)
def bootstrap_lines(spark, sf_dir):
    """Lines of value on hour for the data and 30 bootstrap samples, from one aggregate."""
    made = curves.replicate_grams(load(spark, sf_dir, "events"), [F.lit(1.0), F.hour("ts").cast("double")], "value", "event_id", 30)
    slope = (F.col("n") * F.col("c1") - F.col("g0_1") * F.col("c0")) / (F.col("n") * F.col("g1_1") - F.col("g0_1") * F.col("g0_1"))
    return made.select("replicate", r6(slope).alias("slope"), r6((F.col("c0") - slope * F.col("g0_1")) / F.col("n")).alias("intercept"))


@query()
def spline_curve(spark, sf_dir):
    """Price by quantity with a bootstrap band."""
    rows = load(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"))
    return curves.spline_regression(rows, "l_quantity", "y", "key", [float(k) for k in range(1, 51, 7)], n=40)


@query()
def robust_line(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    found = [(kind, *map(float, curves.robust_line(rows, "l_quantity", "y", kind == "perpendicular"))) for kind in ("perpendicular", "vertical")]
    return spark.createDataFrame(found, "distance string, slope double, intercept double")


@query()
def decay_fit(spark, sf_dir):
    """Exponential through the numbers of events of a user by the days between them."""
    from pyspark.sql import Window

    at = seconds("ts")
    gap = at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = load(spark, sf_dir, "events").select((F.floor(gap / 21600) / 4).alias("x")).where("x is not null").groupBy("x").agg(F.count("*").cast("double").alias("y"))
    (length, scale, offset), error = curves.exponential_decay(rows, "x", "y", (0.5, 1000.0, 0.0))
    return spark.createDataFrame([(float(length), float(scale), float(offset), error)], "length double, scale double, offset double, error double")


@query(
    f"WITH t AS (SELECT event_type AS g, value AS y, cos({_ANGLE}) AS c, sin({_ANGLE}) AS s FROM events), m AS (SELECT g, covar_pop(c, c) AS cc, covar_pop(s, s) AS ss, covar_pop(c, s) AS cs, covar_pop(c, y) AS cy, covar_pop(s, y) AS sy, var_pop(y) AS yy FROM t GROUP BY g),"
    " w AS (SELECT *, (ss * cy - cs * sy) / (cc * ss - cs * cs) AS a, (cc * sy - cs * cy) / (cc * ss - cs * cs) AS b FROM m) SELECT g AS event_type, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b, round(sqrt(a * a + b * b), 4) AS d, round((a * cy + b * sy) / yy, 6) AS r2 FROM w"
)
def circular_regression_fit(spark, sf_dir):
    """Daily cycle of values by event type; the same call gives bands and p-values."""
    found = curves.circular_regression(angles(spark, sf_dir), "a", "value", "event_id", ["event_type"], n=20, shuffles=20)
    rows = [(r["event_type"], *(float(r[k]) for k in ("a", "b", "d", "r2"))) for r in found]
    made = spark.createDataFrame(rows, "event_type string, a double, b double, d double, r2 double")
    return made.select("event_type", *((F.round(c, 4) + 0.0).alias(c) for c in "abd"), r6("r2").alias("r2"))
