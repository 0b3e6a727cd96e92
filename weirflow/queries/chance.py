"""Resampled order statistics and shuffle tests. Draws are MD5 digits, so SQL repeats them."""

from pyspark.sql import functions as F

from ..operators import adaptive, quantiles as qt
from ..sources.tables import load
from .registry import query, r6


def _u(key: str, seed: int = 0) -> str:
    """The draw of a key and replicate r."""
    return f"(CAST(CAST('0x' || substr(md5('{seed}:' || {key} || ':' || r), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496)"


def _unit(u: str) -> str:
    out, term, total = "CASE", 2.718281828459045**-1, 0.0
    for k in range(12):
        total += term
        term /= k + 1
        out += f" WHEN {u} < {total!r}::DOUBLE THEN {k}"
    return out + " ELSE 12 END"


#: Quantiles by arm of weighted rows w (g, r, arm, x, w, p): as numpy has them for the rows repeated.
_Q = """c AS (SELECT *, sum(w) OVER (PARTITION BY g, r, arm, p ORDER BY x) AS upto, (sum(w) OVER (PARTITION BY g, r, arm, p) - 1) * p AS place FROM w WHERE w > 0),
    q AS (SELECT g, r, arm, p, min(x) FILTER (upto > floor(place)) + any_value(place - floor(place)) * (min(x) FILTER (upto > ceil(place)) - min(x) FILTER (upto > floor(place))) AS v FROM c GROUP BY ALL)"""


@query(f"WITH w AS (SELECT event_type AS g, r, '' AS arm, value AS x, p, {_unit(_u('event_id'))} AS w FROM events, range(25) t(r), (SELECT unnest([0.25::DOUBLE, 0.5, 0.9]) AS p)), {_Q} SELECT g AS event_type, CAST(r AS INTEGER) AS replicate, p, round(v, 6) AS value FROM q")
def bootstrap_quantiles(spark, sf_dir):
    """Quartile, median and upper tail of the events of a type in 25 bootstrap samples."""
    made = qt.bootstrap_quantiles(load(spark, sf_dir, "events"), "value", "event_id", 25, (0.25, 0.5, 0.9), ["event_type"])
    return made.select("event_type", "replicate", "p", r6("value").alias("value"))


@query(
    "WITH v AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY l_returnflag), t AS (SELECT *, (len(v) - 1) * p AS h FROM v, (SELECT unnest([0.0::DOUBLE, 0.1, 0.5, 0.975, 1.0]) AS p))"
    " SELECT l_returnflag, p, round(v[CAST(floor(h) AS BIGINT) + 1] + (h - floor(h)) * (v[CAST(ceil(h) AS BIGINT) + 1] - v[CAST(floor(h) AS BIGINT) + 1]), 6) AS value FROM t"
)
def exact_quantiles(spark, sf_dir):
    made = qt.exact_quantiles(load(spark, sf_dir, "lineitem"), "l_extendedprice", [0.0, 0.1, 0.5, 0.975, 1.0], ["l_returnflag"])
    return made.select("l_returnflag", "p", r6("value").alias("value"))


@query(
    f"WITH d AS (SELECT event_type, r, value AS x, date_part('hour', ts) + 0.0 AS y, CAST({_unit(_u('event_id', 3))} AS DOUBLE) AS w FROM events, range(25) t(r)), m AS (SELECT event_type, r, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM d GROUP BY ALL)"
    " SELECT event_type, CAST(r AS INTEGER) AS replicate, round((sum(w * x * y) / any_value(n) - any_value(mx * my)) / sqrt((sum(w * x * x) / any_value(n) - any_value(mx * mx)) * (sum(w * y * y) / any_value(n) - any_value(my * my))), 6) + 0.0 AS value FROM d JOIN m USING (event_type, r) GROUP BY ALL"
)
def bootstrap_correlation(spark, sf_dir):
    """Correlation of value and hour in bootstrap samples: any aggregate with weights will do."""
    x, y = F.col("value"), F.col("hour").cast("double")

    def correlation(w):
        mean = lambda c: F.sum(w * c) / F.sum(w)
        return (mean(x * y) - mean(x) * mean(y)) / F.sqrt((mean(x * x) - mean(x) * mean(x)) * (mean(y * y) - mean(y) * mean(y)))

    rows = load(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    made = qt.bootstrap_statistic(rows, "event_id", 25, correlation, ["event_type"], 3)
    return made.select("event_type", "replicate", r6("value").alias("value"))


_CUSTOMERS = "t AS (SELECT c_custkey AS k, c_acctbal AS x, c_mktsegment = 'BUILDING' AS a FROM customer), s AS (SELECT CAST(count(*) FILTER (a) AS DOUBLE) AS na, CAST(count(*) FILTER (NOT a) AS DOUBLE) AS nb FROM t)"


@query(
    f"WITH {_CUSTOMERS}, f AS (SELECT k, sum(exp(-na / nb) * pow(na / nb, k) / gamma(k + 1)) OVER (ORDER BY k) AS c FROM s, range(0, 40) z(k)),"
    f" w AS (SELECT 0 AS g, CAST(r AS BIGINT) AS r, 'null' AS arm, x, 0.5::DOUBLE AS p, (SELECT count(*) FROM f WHERE c <= {_u('t.k')}) AS w FROM t, range(60) v(r) WHERE NOT a UNION ALL SELECT 0, -1, CASE WHEN a THEN 'a' ELSE 'b' END, x, 0.5, 1 FROM t), {_Q},"
    " o AS (SELECT max(v) FILTER (arm = 'a') AS a, max(v) FILTER (arm = 'b') AS b FROM q)"
    " SELECT round(a, 6) AS first, round(b, 6) AS second, round(avg(CASE WHEN abs(v - b) > abs(a - b) THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM q, o WHERE arm = 'null' GROUP BY a, b"
)
def median_null_test(spark, sf_dir):
    """Median balance of one segment against samples of its size from the others."""
    made = qt.null_quantile_test(load(spark, sf_dir, "customer"), "c_acctbal", F.col("c_mktsegment") == "BUILDING", "c_custkey", 60)
    return made.select(*(r6(c).alias(c) for c in ("first", "second", "p_value")))


@query(
    f"WITH t AS (SELECT event_type AS g, event_id AS k, value AS x, user_id % 2 = 0 AS a FROM events), s AS (SELECT g, avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS share FROM t GROUP BY g),"
    f" w AS (SELECT g, r, CASE WHEN {_u('k')} < share THEN 'a' ELSE 'b' END AS arm, x, 0.5::DOUBLE AS p, 1 AS w FROM t JOIN s USING (g), range(40) v(r) UNION ALL SELECT g, -1, CASE WHEN a THEN 'a' ELSE 'b' END, x, 0.5, 1 FROM t), {_Q},"
    " d AS (SELECT g, r, abs(max(v) FILTER (arm = 'a') - max(v) FILTER (arm = 'b')) AS d FROM q GROUP BY ALL)"
    " SELECT g AS event_type, round(o.d, 6) AS delta, round((count(*) FILTER (n.d > o.d) + 1) / 41, 6) AS p_value FROM d n JOIN d o USING (g) WHERE o.r = -1 AND n.r >= 0 GROUP BY g, o.d"
)
def median_permutation_test(spark, sf_dir):
    """Difference of medians between two halves of the users, by event type."""
    made = qt.permuted_quantile_test(load(spark, sf_dir, "events"), "value", F.col("user_id") % 2 == 0, "event_id", 40, by=["event_type"])
    return made.select("event_type", r6("delta").alias("delta"), r6("p_value").alias("p_value"))


def _beta(x: str) -> str:
    """Beta distribution with k + 1/2 and n - k + 1/2 up to x: powers of sine and cosine by Simpson's rule."""
    area = lambda end: f"({end}) * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(sin(i * ({end}) / 2000), 2 * k) * pow(cos(i * ({end}) / 2000), 2 * (n - k))))"
    return f"({area(f'asin(sqrt({x}))')} / ({area('pi() / 2')}))"


@query(
    f"WITH t AS (SELECT event_type AS g, event_id AS k, value AS x, user_id % 3 = 0 AS a FROM events), s AS (SELECT g, avg(x) FILTER (a) - avg(x) FILTER (NOT a) AS seen, avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS share FROM t GROUP BY g),"
    f" v AS (SELECT g, r, seen - (avg(x) FILTER ({_u('k')} < share) - avg(x) FILTER ({_u('k')} >= share)) AS v FROM t JOIN s USING (g), range(2048) z(r) GROUP BY g, r, seen),"
    " b AS (SELECT g, n, count(*) FILTER (v < 0) AS k FROM v, (SELECT unnest([16, 32, 64, 128, 256, 512, 1024, 2048]) AS n) WHERE r < n GROUP BY g, n),"
    f" f AS (SELECT *, {_beta('0.025')} AS low, {_beta('0.975')} AS high FROM b),"
    " j AS (SELECT *, (low > 0.995 OR low <= 0.005) AND (high > 0.995 OR high <= 0.005) AS decided FROM f)"
    " SELECT g AS event_type, CAST(n AS BIGINT) AS n, least(k, n - k) AS k, decided FROM j QUALIFY row_number() OVER (PARTITION BY g ORDER BY decided DESC, CASE WHEN decided THEN n ELSE -n END) = 1"
)
def adaptive_shuffle(spark, sf_dir):
    """Is the mean of a third of the users another than that of the rest? By event type, with as many shuffles as it takes."""
    events = load(spark, sf_dir, "events")
    sampler = adaptive.shuffled_mean_difference("value", F.col("user_id") % 3 == 0, "event_id", ["event_type"])
    return adaptive.adaptive_test(events, sampler, ["event_type"]).select("event_type", "n", "k", "decided")
