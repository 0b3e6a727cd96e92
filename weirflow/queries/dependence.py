"""Information measures, corrections for many tests, circular correlation."""

from pyspark.sql import functions as F

from ..operators import information as inf, multitest as mt, summary
from ..sources.tables import load
from .registry import query, r6
from .values import _ANGLE, angles

_J = "SELECT l_returnflag AS x, l_linestatus AS y, CAST(floor(l_quantity / 10) AS BIGINT) AS q, count(*) * 1.0 AS n FROM lineitem GROUP BY ALL"


def _counts(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y"), F.floor(F.col("l_quantity") / 10).cast("long").alias("q"))
    return inf.joint(rows, "x", "y", "q")


def _h(columns: str) -> str:
    return f"(SELECT -sum(p * ln(p)) FROM (SELECT sum(n) / (SELECT sum(n) FROM j) AS p FROM j GROUP BY {columns}))"


@query(f"WITH j AS ({_J}) SELECT x, y, q, CAST(n AS DOUBLE) AS n FROM j")
def joint_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"WITH j AS ({_J}) SELECT round({_h('x')}, 6) AS h")
def entropy(spark, sf_dir):
    return inf.entropy(_counts(spark, sf_dir), ["x"]).select(r6("h").alias("h"))


@query(f"WITH j AS ({_J}) SELECT round({_h('x, q')} - {_h('x')}, 6) AS h")
def conditional_entropy(spark, sf_dir):
    return inf.conditional_entropy(_counts(spark, sf_dir), ["q"], ["x"]).select(r6("h").alias("h"))


@query(f"WITH j AS ({_J}) SELECT round({_h('x')} + {_h('y')} - {_h('x, y')}, 6) AS mi")
def mutual_information(spark, sf_dir):
    return inf.mutual_information(_counts(spark, sf_dir), ["x"], ["y"]).select(r6("mi").alias("mi"))


@query(f"WITH j AS ({_J}), p AS (SELECT q, sum(n) FILTER (x = 'A') AS a, sum(n) FILTER (x = 'R') AS r FROM j GROUP BY q) SELECT round(sum(a / (SELECT sum(a) FROM p) * ln(a / (SELECT sum(a) FROM p) / (r / (SELECT sum(r) FROM p)))), 6) + 0.0 AS kl FROM p WHERE a > 0")
def dkl(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    of = lambda v: counts.where(F.col("x") == v).groupBy("q").agg(F.sum("n").alias("n"))
    return inf.divergence(of("A"), of("R"), ["q"]).select(r6("kl").alias("kl"))


_SH = f"WITH j0 AS ({_J}), j AS (SELECT y, q, x, sum(n) AS n FROM j0 GROUP BY ALL), k AS (SELECT a.y, b.q, a.x, a.n * b.n / t.n AS n FROM (SELECT y, x, sum(n) AS n FROM j GROUP BY ALL) a JOIN (SELECT q, x, sum(n) AS n FROM j GROUP BY ALL) b USING (x) JOIN (SELECT x, sum(n) AS n FROM j GROUP BY ALL) t USING (x))"


def _i(t: str, a: str) -> str:
    e = lambda c: f"(SELECT -sum(p * ln(p)) FROM (SELECT sum(n) / (SELECT sum(n) FROM {t}) AS p FROM {t} GROUP BY {c}))"
    return f"({e(a)} + {e('x')} - {e(a + ', x')})"


@query(f"{_SH} SELECT round({_i('j', 'y, q')}, 6) AS i, round({_i('k', 'y, q')}, 6) AS i_shuffled, round({_i('j', 'y')}, 6) AS i_x, round({_i('j', 'q')}, 6) AS i_y, round({_i('j', 'y, q')} - {_i('k', 'y, q')}, 5) + 0.0 AS delta_shuffled, round({_i('j', 'y, q')} - {_i('j', 'y')} - {_i('j', 'q')}, 5) + 0.0 AS synergy")
def shuffle_information(spark, sf_dir):
    made = inf.shuffle_information(_counts(spark, sf_dir), "y", "q", "x")
    return made.select(*(r6(c).alias(c) for c in ("i", "i_shuffled", "i_x", "i_y")), *((F.round(c, 5) + 0.0).alias(c) for c in ("delta_shuffled", "synergy")))


@query(f"WITH j AS ({_J}), a AS (SELECT x, y, sum(n) + 0.5 AS a FROM j GROUP BY ALL) SELECT x, y, round(a / sum(a) OVER (), 6) AS p FROM a")
def smoothed_probabilities(spark, sf_dir):
    return inf.smoothed(_counts(spark, sf_dir), ["x", "y"]).select("x", "y", r6("p").alias("p"))


@query("SELECT h.a, h.b, CAST(count(e.event_id) AS DOUBLE) AS n FROM (SELECT a, b FROM (SELECT unnest(range(0, 7)) AS a), (SELECT unnest(range(0, 5)) AS b)) h LEFT JOIN events e ON e.user_id % 7 = h.a AND CAST(floor(e.value / 25) AS BIGINT) = h.b GROUP BY ALL")
def joint_counts_dense(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("a"), F.floor(F.col("value") / 25).cast("long").alias("b"))
    return inf.dense(inf.joint(rows, "a", "b"), {"a": 7, "b": 5})


def _p(spark, sf_dir):
    """p-values: mean rank of a user's values, skewed towards small."""
    made = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("k"), F.round(F.pow(F.avg(F.least(F.col("value") / 100, F.lit(1.0))), 6), 9).alias("p"))
    return made.withColumn("family", F.col("user_id") % 3)


_PV = "p AS (SELECT user_id, count(*) AS k, round(pow(avg(least(value / 100, 1.0)), 6), 9) AS p, user_id % 3 AS family FROM events GROUP BY user_id)"
_BH = f"WITH {_PV}, r AS (SELECT *, count(*) OVER (PARTITION BY family) AS n, count(*) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM p), a AS (SELECT *, least(min(p * n / rk) OVER (PARTITION BY family ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS adj FROM r)"


@query(_BH + " SELECT user_id, round(adj, 6) AS p_adjusted, adj <= 0.05 AS rejected FROM a")
def bh_adjust(spark, sf_dir):
    return mt.benjamini_hochberg(_p(spark, sf_dir), "p", "family").select("user_id", r6("p_adjusted").alias("p_adjusted"), "rejected")


@query(_BH + " SELECT r.family, max(p) FILTER (p <= 0.05 * rk / n) AS p_independent, max(p) FILTER (p <= 0.05 * rk / n / h) AS p_any FROM r JOIN (SELECT family, sum(1.0 / k2) AS h FROM (SELECT DISTINCT family, n, unnest(range(1, n + 1)) AS k2 FROM r) GROUP BY family) USING (family) GROUP BY r.family")
def by_threshold(spark, sf_dir):
    return mt.thresholds(_p(spark, sf_dir), "p", "family")


@query(
    _BH
    + """, s AS (SELECT family, user_id, p, n, rk, sum(CAST(adj <= 0.05 / 1.05 AS INT)) OVER (PARTITION BY family) AS rej, adj FROM a)
    SELECT user_id, round(least(adj * (n - rej) / n * 1.05, 1.0), 6) AS p_adjusted FROM s"""
)
def two_stage_adjust(spark, sf_dir):
    return mt.two_stage(_p(spark, sf_dir), "p", "family").select("user_id", r6("p_adjusted").alias("p_adjusted"))


@query(f"WITH {_PV} SELECT family, round(0.5 - atan(avg(tan((0.5 - p) * pi()))) / pi(), 6) AS p FROM p WHERE p > 1e-6 GROUP BY family")
def cauchy_combine(spark, sf_dir):
    return _p(spark, sf_dir).where("p > 1e-6").groupBy("family").agg(r6(mt.cauchy_combine(F.col("p"))).alias("p"))


@query(f"WITH c AS (SELECT event_type, a, v, atan2(avg(sin(a)) OVER w, avg(cos(a)) OVER w) AS ma, atan2(avg(sin(v)) OVER w, avg(cos(v)) OVER w) AS mv FROM (SELECT event_type, {_ANGLE} AS a, value / 50 AS v FROM events) WINDOW w AS (PARTITION BY event_type)) SELECT event_type, round(corr(sin(a - ma), sin(v - mv)), 6) + 0.0 AS r FROM c GROUP BY event_type")
def circular_correlation(spark, sf_dir):
    rows = angles(spark, sf_dir).withColumn("v", F.col("value") / 50)
    return summary.circcorr(rows, "a", "v", "event_type").select("event_type", r6("r").alias("r"))


@query(f"WITH c AS (SELECT event_type, atan2(sin(a - v), cos(a - v)) AS d FROM (SELECT event_type, {_ANGLE} AS a, value / 50 AS v FROM events)) SELECT event_type, round(avg(abs(d)), 6) AS l1, round(sqrt(avg(d * d)), 6) AS l2 FROM c GROUP BY event_type")
def wrapped_errors(spark, sf_dir):
    a, v = F.col("a"), F.col("value") / 50
    return angles(spark, sf_dir).groupBy("event_type").agg(r6(summary.wrapped_error(a, v)).alias("l1"), r6(summary.wrapped_error(a, v, "L2")).alias("l2"))
