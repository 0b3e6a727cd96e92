"""Windows, blocks and neighbours of sampled series."""

from pyspark.sql import functions as F

from ..operators import windows as w
from ..sources.tables import load, series
from .registry import SERIES, query, r6

BY, I, X = "user_id", "i", "value"
_O = "PARTITION BY user_id ORDER BY i"


def samples(spark, sf_dir):
    return series(load(spark, sf_dir, "events"))


def _block(stat: str, column) -> None:
    def run(spark, sf_dir):
        return w.stats_block(samples(spark, sf_dir), BY, I, 10, y=column()).select(BY, "block", r6("y").alias("y"))

    run.__name__ = f"block_{stat}"
    sql = {"mean": "avg(value)", "var": "var_pop(value)", "median": "median(value)"}[stat]
    query(f"{SERIES} SELECT user_id, CAST(floor(i / 10) AS BIGINT) AS block, round({sql}, 6) + 0.0 AS y FROM s GROUP BY ALL HAVING count(*) = 10")(run)


_block("mean", lambda: F.avg(X))
_block("var", lambda: F.var_pop(X))
_block("median", lambda: F.median(X))


def _sliding(name: str, column, sql: str) -> None:
    def run(spark, sf_dir):
        return samples(spark, sf_dir).select("event_id", r6(column()).alias("y"))

    run.__name__ = name
    query(f"{SERIES} SELECT event_id, round({sql}, 6) + 0.0 AS y FROM s")(run)


_FRAME = f"OVER ({_O} ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)"
_sliding("sliding_median", lambda: w.median_filter(X, BY, I, 10), f"quantile_cont(value, 0.5) {_FRAME}")
_sliding("sliding_percentile", lambda: w.percentile_filter(X, BY, I, 0.9, 10), f"quantile_cont(value, 0.9) {_FRAME}")
_sliding("sliding_variance", lambda: w.variance_filter(X, BY, I, 10), f"var_pop(value) {_FRAME}")
_sliding("central_difference", lambda: w.central_difference(X, BY, I), f"(lead(value) OVER ({_O}) - lag(value) OVER ({_O})) * 240.0 / 2")
_N = "(count(*) OVER (PARTITION BY user_id) - 1)"
_sliding(
    "spaced_derivative",
    lambda: w.spaced_derivative(X, BY, I),
    f"coalesce((value - lag(value) OVER ({_O})) * (i / nullif({_N}, 0)) + (lead(value) OVER ({_O}) - value) * (1 - i / nullif({_N}, 0)), lead(value) OVER ({_O}) - value, value - lag(value) OVER ({_O}))",
)


def _fir_sql(taps):
    half = len(taps) // 2
    first, last = f"first_value(value) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", f"last_value(value) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    parts = []
    for k, t in enumerate(taps):
        d = k - half
        at = "value" if d == 0 else f"coalesce(lag(value, {-d}) OVER ({_O}), {first})" if d < 0 else f"coalesce(lead(value, {d}) OVER ({_O}), {last})"
        parts.append(f"CAST({t!r} AS DOUBLE) * {at}")
    return " + ".join(parts)


_sliding("gaussian_smooth", lambda: w.gaussian_smooth(X, BY, I, 1.5), _fir_sql(w.gaussian_taps(1.5)))
_sliding("savgol_smooth", lambda: w.fir(X, BY, I, w.savgol_taps(4, 3)), _fir_sql(w.savgol_taps(4, 3)))
_sliding("savgol_velocity", lambda: w.fir(X, BY, I, w.savgol_taps(4, 3, 1)), _fir_sql(w.savgol_taps(4, 3, 1)))
_sliding("savgol_acceleration", lambda: w.fir(X, BY, I, w.savgol_taps(4, 3, 2)), _fir_sql(w.savgol_taps(4, 3, 2)))
_sliding("savgol_jerk", lambda: w.fir(X, BY, I, w.savgol_taps(4, 3, 3)), _fir_sql(w.savgol_taps(4, 3, 3)))


@query(
    f"""{SERIES}, n AS (SELECT user_id, max(i) AS z FROM s GROUP BY user_id),
    p AS (SELECT user_id, i, value FROM s UNION ALL SELECT user_id, -i, value FROM s WHERE i BETWEEN 1 AND 6
    UNION ALL SELECT user_id, 2 * z - i, value FROM s JOIN n USING (user_id) WHERE i < z AND 2 * z - i <= z + 6),
    b AS (SELECT user_id, i, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS y FROM p)
    SELECT user_id, i, round(y, 6) AS y FROM b JOIN n USING (user_id) WHERE i BETWEEN 0 AND z"""
)
def box_filter(spark, sf_dir):
    return w.box_filter(samples(spark, sf_dir), X, BY, I, 6, "y").select(BY, I, r6("y").alias("y"))


@query(f"{SERIES} SELECT event_id, value AS lag_0, " + ", ".join(f"coalesce(lag(value, {2 * k}) OVER ({_O}), first_value(value) OVER ({_O})) AS lag_{k}" for k in range(1, 4)) + " FROM s")
def lagged_features(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", *w.lagged(X, BY, I, 4, 2))


_SIGNS = f"sign(value - lag(value) OVER ({_O})) AS b, sign(lead(value) OVER ({_O}) - value) AS a"


@query(f"{SERIES} SELECT event_id FROM (SELECT event_id, {_SIGNS} FROM s) WHERE a < b")
def local_maxima(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("peak", w.local_maxima(X, BY, I)).where("peak").select("event_id")


@query(f"{SERIES} SELECT event_id FROM (SELECT event_id, {_SIGNS} FROM s) WHERE a > b OR b IS NULL AND a > 0 OR a IS NULL AND b < 0")
def local_minima_with_ends(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("peak", w.local_minima(X, BY, I, endpoints=True)).where("peak").select("event_id")


@query(
    f"""{SERIES}, t AS (SELECT user_id, i, value AS y, lag(value) OVER ({_O}) AS l, lead(value) OVER ({_O}) AS r, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, i) AS k FROM s)
    SELECT user_id, i, round(i + coalesce(CASE WHEN l - 2 * y + r <> 0 THEN 0.5 * (l - r) / (l - 2 * y + r) END, 0), 6) AS place, y AS peak FROM t WHERE k = 1"""
)
def peak_interpolated(spark, sf_dir):
    return w.quadratic_peak(samples(spark, sf_dir), X, BY, I).select(BY, "i", r6("place").alias("place"), "peak")


@query(f"{SERIES}, c AS (SELECT user_id, i, value - avg(value) OVER (PARTITION BY user_id) AS c FROM s), p AS (SELECT a.user_id, b.i - a.i AS lag, avg(a.c * b.c) AS p FROM c a JOIN c b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 0 AND 5 GROUP BY ALL) SELECT p.user_id, p.lag, round(p.p / nullif(z.p, 0), 6) + 0.0 AS r FROM p JOIN p z ON p.user_id = z.user_id AND z.lag = 0")
def autocorrelation_lags(spark, sf_dir):
    return w.autocorrelation(samples(spark, sf_dir), X, BY, I, 5).select(BY, "lag", r6("r").alias("r"))


@query(f"{SERIES} SELECT a.event_id, round(sum(b.value * CASE WHEN b.i = 0 THEN pow(0.8, a.i) ELSE 0.2 * pow(0.8, a.i - b.i) END), 6) AS y FROM s a JOIN s b ON b.user_id = a.user_id AND b.i <= a.i GROUP BY a.event_id")
def exponential_average(spark, sf_dir):
    return w.ema(samples(spark, sf_dir), X, BY, I, 0.8, "y").select("event_id", r6("y").alias("y"))
