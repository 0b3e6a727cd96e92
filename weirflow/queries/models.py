"""Linear models, folds and resampling."""

from pyspark.sql import functions as F

from ..operators import linmodel as lm, resample as rs
from ..plans.joins import draw
from ..sources.tables import load, series
from .registry import SERIES, query, r6

X = ["one", "l_quantity", "l_discount"]


def _items(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0)).withColumn("y", F.col("l_extendedprice") / 1000)


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * l_quantity), 3) AS qq, round(sum(l_quantity * l_discount), 3) AS qd, round(sum(l_discount * l_discount), 5) AS dd, round(sum(l_quantity * l_extendedprice / 1000), 2) AS qy FROM lineitem GROUP BY l_returnflag")
def gram_moments(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return _items(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(q * q), 3).alias("qq"), F.round(F.sum(q * d), 3).alias("qd"), F.round(F.sum(d * d), 5).alias("dd"), F.round(F.sum(q * F.col("y")), 2).alias("qy"))


@query("SELECT round(regr_slope(l_extendedprice / 1000, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice / 1000, l_quantity), 4) + 0.0 AS intercept FROM lineitem")
def ridge_line(spark, sf_dir):
    """Two-feature least squares through the Gram matrix."""
    ((g, c, _, _),) = lm.gram(_items(spark, sf_dir), ["one", "l_quantity"], "y").values()
    w = lm.ridge(g, c)
    return spark.createDataFrame([(round(float(w[1]), 5), round(float(w[0]), 4) + 0.0)], "slope double, intercept double")


@query()
def crossvalidated_ridge(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("fold", F.col("l_orderkey") % 5)
    found = lm.crossvalidated_ridge(rows, X, "y", "fold", 1e-6)
    return spark.createDataFrame([(int(f), float(v["mse"]), [float(x) for x in v["weights"]]) for f, v in sorted(found.items())], "fold long, mse double, weights array<double>")


@query()
def ridge_sweep(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("fold", F.col("l_orderkey") % 5)
    found = lm.ridge_sweep(rows, X, "y", "fold", [1e-6, 1.0, 1e3, 1e6])
    return spark.createDataFrame(sorted(found.items()), "reg double, mse double")


@query()
def principal_axes(spark, sf_dir):
    values, vectors = lm.pca(_items(spark, sf_dir), ["l_quantity", "l_discount", "l_tax", "y"], 2, centre=True)
    return spark.createDataFrame([(k, float(a), [float(v) for v in b]) for k, (a, b) in enumerate(zip(values, vectors, strict=True))], "axis long, value double, vector array<double>")


@query()
def circular_regression(spark, sf_dir):
    from .values import angles

    found = lm.circular_regression(angles(spark, sf_dir), "a", "value", ["event_type"])
    return spark.createDataFrame([(k[0], *(float(v) for v in f.values())) for k, f in sorted(found.items())], "event_type string, phase double, depth double, mean double, r2 double")


@query()
def poisson_regression(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select((F.col("value") / 100).alias("x"), F.floor(F.col("value") / 40).cast("double").alias("y"))
    w = lm.poisson_glm(rows, ["x"], "y")
    return spark.createDataFrame([(float(w[0]), float(w[1]))], "constant double, slope double")


@query()
def logistic_regression(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select((F.col("value") / 100).alias("x"), (F.col("event_type") == "click").cast("double").alias("y"))
    w = lm.logistic_glm(rows, ["x"], "y")
    return spark.createDataFrame([(float(w[0]), float(w[1]))], "constant double, slope double")


@query("SELECT round((w * ab - a * b) / (w * aa - a * a), 6) AS slope, round((b - (w * ab - a * b) / (w * aa - a * a) * a) / w, 6) AS intercept FROM (SELECT sum(l_tax + 0.01) AS w, sum((l_tax + 0.01) * x) AS a, sum((l_tax + 0.01) * y) AS b, sum((l_tax + 0.01) * x * x) AS aa, sum((l_tax + 0.01) * x * y) AS ab FROM (SELECT l_tax, ln(l_quantity) AS x, ln(l_extendedprice) AS y FROM lineitem))")
def power_law(spark, sf_dir):
    made = lm.power_law(_items(spark, sf_dir).withColumn("w", F.col("l_tax") + 0.01), "l_quantity", "l_extendedprice", "w")
    return made.select(r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query()
def poisson_mixture(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.floor(F.col("value") / 10).cast("double").alias("n"))
    return spark.createDataFrame([tuple(map(float, lm.two_class_poisson(rows, "n")))], "low double, high double, share double")


@query(f"{SERIES} SELECT user_id, i, least(CAST(floor(i / floor(n / 5)) AS BIGINT), 4) AS fold FROM (SELECT user_id, i, count(*) OVER (PARTITION BY user_id) AS n FROM s) WHERE n >= 5")
def crossval_folds(spark, sf_dir):
    from pyspark.sql import Window

    rows = series(load(spark, sf_dir, "events")).withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).where("n >= 5")
    return rows.select("user_id", "i", rs.folds(F.col("i"), F.col("n"), 5).alias("fold"))


@query("SELECT user_id, n, least(CAST(floor((sum(n) OVER (ORDER BY user_id) - n / 2.0) * 4 / sum(n) OVER ()) AS BIGINT), 3) AS fold FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def balanced_trials(spark, sf_dir):
    lengths = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return rs.balanced_folds(lengths, "user_id", "n", 4)


@query()
def bootstrap_mean_ci(spark, sf_dir):
    samples = rs.bootstrap_mean(load(spark, sf_dir, "events"), "value", "event_id", 100, by=["event_type"])
    return rs.interval(samples, "mean", ["event_type"])


@query()
def permutation_test(spark, sf_dir):
    return rs.permutation_test(load(spark, sf_dir, "events"), "value", F.col("event_type") == "purchase", "event_id", 200)


@query()
def block_bootstrap(spark, sf_dir):
    rows = series(load(spark, sf_dir, "events"))
    return rs.blocks_bootstrap(rows, "user_id", "i", 10).select("user_id", F.col("to").alias("i"), "value")


@query(f"{SERIES}, m AS (SELECT user_id, floor((max(i) + 1) / 10) AS n FROM s GROUP BY user_id) SELECT s.user_id, count(*) AS n, round(sum(value), 4) AS total FROM s JOIN m USING (user_id) WHERE i < n * 10 GROUP BY s.user_id")
def block_permutation(spark, sf_dir):
    """Permuting whole blocks keeps every sample of them: counts and sums tell."""
    rows = rs.blocks_bootstrap(series(load(spark, sf_dir, "events")), "user_id", "i", 10, replace=False)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query()
def monte_carlo_moments(spark, sf_dir):
    """Mean and second moment of the square root of a uniform number, by seeded draws."""
    u = F.sqrt(draw(11, F.col("id")))
    return spark.range(100000).agg(F.round(F.avg(u), 6).alias("mean"), F.round(F.avg(u * u), 6).alias("second"))
