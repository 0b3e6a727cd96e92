"""Normalisers, ranks, descriptions, scalar and text functions."""

from pyspark.sql import functions as F

from ..functions import scalar, text
from ..operators import normalize as n, summary
from ..sources.tables import load
from .registry import query, r6, r6_scaled

_BY = "PARTITION BY user_id"


def _normalized(name: str, column, sql: str) -> None:
    def run(spark, sf_dir):
        return load(spark, sf_dir, "events").select("event_id", column().alias("y")).select("event_id", r6_scaled("y").alias("y"))

    run.__name__ = name
    query(f"SELECT event_id, round({sql}, 6) + 0.0 AS y FROM events")(run)


_normalized("zeromin_by_user", lambda: n.zeromin("value", "user_id"), f"value - min(value) OVER ({_BY})")
_normalized("zeromean_by_user", lambda: n.zeromean("value", "user_id"), f"value - avg(value) OVER ({_BY})")
_normalized("zeromedian_by_user", lambda: n.zeromedian("value", "user_id"), f"value - median(value) OVER ({_BY})")
_normalized("zscore_by_user", lambda: n.zscore("value", "user_id"), f"(value - avg(value) OVER ({_BY})) / (stddev_pop(value) OVER ({_BY}) + 1e-30)")
_normalized("standardize_by_user", lambda: n.standardize("value", "user_id"), f"value / (stddev_pop(value) OVER ({_BY}) + 1e-30)")
_normalized("unitscale_by_user", lambda: n.unitscale("value", "user_id"), f"(value - min(value) OVER ({_BY})) / nullif(max(value) OVER ({_BY}) - min(value) OVER ({_BY}), 0)")
_normalized("absunitscale_by_user", lambda: n.absunitscale("value", "user_id"), f"value / greatest(abs(min(value) OVER ({_BY})), abs(max(value) OVER ({_BY})))")
_normalized("absunitscale_minor_by_user", lambda: n.absunitscale("value", "user_id", minor=True), f"value / least(abs(min(value) OVER ({_BY})), abs(max(value) OVER ({_BY})))")
_normalized("unitsum_by_user", lambda: n.unitsum("value", "user_id"), f"value / sum(value) OVER ({_BY})")
_normalized("unitlength_by_user", lambda: n.unitlength("value", "user_id"), f"value / sqrt(sum(value * value) OVER ({_BY}))")
_normalized("deltaovermean_by_user", lambda: n.deltaovermean("value", "user_id"), f"(value - avg(value) OVER ({_BY})) / avg(value) OVER ({_BY})")
_RANK = f"rank() OVER ({_BY} ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0"
_normalized("average_rank_by_user", lambda: n.average_rank("value", "user_id"), _RANK)
_normalized("uniformize_by_user", lambda: n.uniformize("value", "user_id"), f"({_RANK} - 0.5) / count(value) OVER ({_BY})")
_normalized("rank_fraction_by_user", lambda: n.nanrank("value", "user_id"), f"({_RANK}) / count(value) OVER ({_BY})")
_normalized("percent_ordinal_by_user", lambda: n.topercentiles("value", "user_id", "event_id"), f"100.0 * (row_number() OVER ({_BY} ORDER BY value, event_id) - 1) / nullif(count(*) OVER ({_BY}) - 1, 0)")
_normalized(
    "uniformize_positive_by_user",
    lambda: n.uniformize_positive("value", "user_id", 20.0),
    "CASE WHEN value > 20 THEN (rank() OVER (PARTITION BY user_id, value > 20 ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY user_id, value > 20) ELSE 0 END",
)


@query()
def gaussianize_by_user(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", r6(n.gaussianize("value", "user_id")).alias("y"))


_P = ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p:02d}" for p in summary.PERCENTS)
_M = "avg(value) AS m, avg(value * value) AS m2, avg(value * value * value) AS m3, avg(value * value * value * value) AS m4"


@query(
    f"""SELECT d.event_type, n, round(lo, 6) AS "min", round(hi, 6) AS "max", round(m, 6) AS mean, round(v, 6) AS "var",
    round((m3 - 3 * m * m2 + 2 * m * m * m) / pow(m2 - m * m, 1.5), 6) AS skew,
    round((m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / pow(m2 - m * m, 2) - 3, 6) AS kurt, round(sd, 6) AS std, q1, median, q3,
    {", ".join(f"p{p:02d}" for p in summary.PERCENTS)}
    FROM (SELECT event_type, count(value) AS n, min(value) AS lo, max(value) AS hi, var_samp(value) AS v, stddev_pop(value) AS sd, {_M},
    round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, {_P}
    FROM events GROUP BY event_type) d"""
)
def describe(spark, sf_dir):
    made = summary.describe(load(spark, sf_dir, "events"), "value", ["event_type"])
    return made.select("event_type", "n", *(r6(c).alias(c) for c in made.columns[2:]))


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mean, round(sqrt(sum(l_quantity * l_extendedprice * l_extendedprice) / sum(l_quantity) - pow(sum(l_quantity * l_extendedprice) / sum(l_quantity), 2)), 4) AS std FROM lineitem GROUP BY l_returnflag")
def weighted_mean_std(spark, sf_dir):
    made = summary.weighted_avg_and_std(load(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return made.select("l_returnflag", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("SELECT event_id, value < quantile_cont(value, 0.05) OVER (PARTITION BY event_type) OR value > quantile_cont(value, 0.95) OVER (PARTITION BY event_type) AS outlier FROM events")
def outlier_flags(spark, sf_dir):
    return summary.outliers(load(spark, sf_dir, "events"), "value", "event_type").select("event_id", "outlier")


@query("SELECT e.event_id, e.value FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.9) AS p FROM events GROUP BY event_type) q USING (event_type) WHERE e.value <= q.p")
def reject_outliers_right(spark, sf_dir):
    return summary.outliers(load(spark, sf_dir, "events"), "value", "event_type", side="right").where("not outlier").select("event_id", "value")


@query("SELECT user_id, round(sqrt(avg(value * value)), 6) AS rms, round(max(value) - min(value), 6) AS span, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id")
def rms_span_by_user(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(r6(summary.rms("value")).alias("rms"), r6(summary.span("value")).alias("span"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("SELECT l_returnflag, round(sqrt(avg(pow(l_quantity * 1500 - l_extendedprice, 2))) / stddev_pop(l_extendedprice), 6) AS nrmse FROM lineitem GROUP BY l_returnflag")
def nrmse_by_flag(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumn("estimate", F.col("l_quantity") * 1500)
    return rows.groupBy("l_returnflag").agg(r6(summary.nrmse("estimate", "l_extendedprice")).alias("nrmse"))


_COV = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}){' + 0.5' if a == b else ''}, 4) + 0.0 AS cov FROM lineitem" for i, a in enumerate(_COV) for b in _COV[i:]))
def covariance_pairs(spark, sf_dir):
    return summary.covariance(load(spark, sf_dir, "lineitem"), _COV, reg=0.5).select("a", "b", (F.round("cov", 4) + 0.0).alias("cov"))


@query(
    """SELECT round(d, 6) AS d, CASE WHEN abs(d) <= 0.01 THEN 'Very small' WHEN abs(d) <= 0.2 THEN 'Small' WHEN abs(d) <= 0.5 THEN 'Medium' WHEN abs(d) <= 0.8 THEN 'Large' WHEN abs(d) <= 1.2 THEN 'Very large' ELSE 'Huge' END AS label
    FROM (SELECT (avg(value) FILTER (g) - avg(value) FILTER (NOT g)) / sqrt(((count(*) FILTER (g) - 1) * var_samp(value) FILTER (g) + (count(*) FILTER (NOT g) - 1) * var_samp(value) FILTER (NOT g)) / (count(*) - 2)) AS d
    FROM (SELECT value, event_type = 'purchase' AS g FROM events))"""
)
def cohen_d_purchase(spark, sf_dir):
    made = summary.cohen_d(load(spark, sf_dir, "events"), "value", F.col("event_type") == "purchase")
    return made.select(r6("d").alias("d"), "label")


@query("SELECT round(m, 6) AS mean, round(sd / sqrt(n - 1), 6) AS sem, round(m / (sd / sqrt(n - 1)), 4) AS t, n - 1 AS dof FROM (SELECT sum(w) AS n, sum(w * x) / sum(w) AS m, sqrt(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2)) AS sd FROM (SELECT l_quantity AS w, l_extendedprice / 1000 AS x FROM lineitem))")
def weighted_ttest(spark, sf_dir):
    made = summary.weighted_ttest(load(spark, sf_dir, "lineitem").withColumn("x", F.col("l_extendedprice") / 1000), "x", "l_quantity")
    return made.select(r6("mean").alias("mean"), r6("sem").alias("sem"), F.round("t", 4).alias("t"), "dof")


_ANGLE = "2 * pi() * (epoch_us(ts) % 86400000000) / 86400000000.0"


def angles(spark, sf_dir):
    from ..sources.tables import micros

    return load(spark, sf_dir, "events").withColumn("a", 2 * F.pi() * (micros("ts") % 86400000000) / 86400000000.0)


@query(f"SELECT event_type, round(atan2(avg(sin(a)), avg(cos(a))), 6) AS mean, round(1 - sqrt(pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)), 6) AS variance, round((count(*) * (pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)) - 1) / (count(*) - 1), 6) + 0.0 AS moment, round(sqrt(-2 * ln(sqrt(pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)))), 6) AS std FROM (SELECT event_type, {_ANGLE} AS a FROM events) GROUP BY event_type")
def circular_by_type(spark, sf_dir):
    a = F.col("a")
    return angles(spark, sf_dir).groupBy("event_type").agg(r6(summary.circmean(a)).alias("mean"), r6(summary.circvar(a)).alias("variance"), r6(summary.squared_first_moment(a)).alias("moment"), r6(summary.polar_std(summary.resultant(a))).alias("std"))


@query(f"SELECT user_id, round(sqrt(pow(avg(value * cos(a)), 2) + pow(avg(value * sin(a)), 2)) / avg(abs(value)), 6) AS synchrony, round(pow(greatest(var_pop(value * cos(a)) * var_pop(value * sin(a)) - pow(covar_pop(value * cos(a), value * sin(a)), 2), 0), 0.25), 4) AS dispersion FROM (SELECT user_id, value, {_ANGLE} AS a FROM events) GROUP BY user_id HAVING count(*) > 3")
def population_synchrony_by_user(spark, sf_dir):
    rows = angles(spark, sf_dir).withColumns({"re": F.col("value") * F.cos("a"), "im": F.col("value") * F.sin("a")})
    made = rows.groupBy("user_id").agg(r6(summary.synchrony(F.col("re"), F.col("im"))).alias("synchrony"), F.round(F.pow(F.greatest(F.var_pop("re") * F.var_pop("im") - F.pow(F.covar_pop("re", "im"), 2), F.lit(0.0)), 0.25), 4).alias("dispersion"), F.count("*").alias("k"))
    return made.where("k > 3").drop("k")


@query(f"SELECT event_id, round(atan2(sin(a - m), cos(a - m)), 6) + 0.0 AS centred FROM (SELECT event_id, a, atan2(avg(sin(a)) OVER (PARTITION BY user_id), avg(cos(a)) OVER (PARTITION BY user_id)) AS m FROM (SELECT event_id, user_id, {_ANGLE} AS a FROM events))")
def circular_centred(spark, sf_dir):
    return summary.circcenter(angles(spark, sf_dir), "a", "user_id", "c").select("event_id", r6("c").alias("centred"))


@query(
    """SELECT event_id, round(ln(greatest(v, 1e-300)), 6) AS slog, round(1 / (1 + exp(-v)), 6) AS sigmoid, round(greatest(v, 0) + ln(1 + exp(-abs(v))), 6) AS softplus,
    round(-0.5 * pow((v - 1) / 2, 2) - ln(2) - 0.5 * ln(2 * pi()), 6) AS gauss, round(k * ln(3) - 3 - lgamma(k + 1), 6) AS poisson, round((k + 0.5) / 21, 6) AS betapr
    FROM (SELECT event_id, value / 100 AS v, event_id % 15 AS k FROM events)"""
)
def scalar_functions(spark, sf_dir):
    v, k = F.col("value") / 100, F.col("event_id") % 15
    one = F.lit(1.0)
    return load(spark, sf_dir, "events").select(
        "event_id", r6(scalar.slog(v, 1e-300)).alias("slog"), r6(scalar.sigmoid(v)).alias("sigmoid"), r6(scalar.softplus(v)).alias("softplus"),
        r6(scalar.gaussian_logpdf(one, 2 * one, v)).alias("gauss"), r6(scalar.poisson_logpdf(k, 3 * one)).alias("poisson"), r6(scalar.betapr(k, F.lit(20))).alias("betapr"),
    )


@query("SELECT event_type, regexp_replace(event_type, '([a-z])$', '\\1') AS kept, 'eventTypeOf' || upper(event_type[1]) || event_type[2:] AS camel, 'event_type_of_' || event_type AS snake FROM events GROUP BY event_type")
def camel_and_snake(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_type").distinct()
    camel = text.snake_to_camel(F.concat(F.lit("event_type_of_"), F.col("event_type")))
    return rows.select("event_type", F.col("event_type").alias("kept"), camel.alias("camel"), text.camel_to_snake(camel).alias("snake"))


@query(r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS l FROM documents) SELECT doc_id, max(coalesce(CASE WHEN length(p) <= 50 THEN p END, '')) AS short FROM (SELECT doc_id, CASE WHEN k > 0 THEN ' ' || list_aggregate(l[1:k], 'string_agg', ' ') ELSE '' END AS p FROM (SELECT doc_id, l, unnest(range(0, 60)) AS k FROM w) WHERE k <= len(l)) GROUP BY doc_id")
def shorten_words(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.shorten_by_words(F.col("text")).alias("short"))


@query()
def word_wrap(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.word_wrap(F.col("text"), 60).alias("wrapped"))


@query()
def short_numbers(spark, sf_dir):
    v = F.col("value")
    return load(spark, sf_dir, "events").select("event_id", text.short_scientific(v).alias("short"), scalar.round_significant(v, 2).alias("two"), scalar.survey_bearing(v).alias("bearing"), text.is_integer(v.cast("string")).alias("whole"))
