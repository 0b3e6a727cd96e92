"""Recursive filters, peaks of spectra, and coherence of channels."""

from pyspark.sql import functions as F

from ..operators import coherence as co, filters, lagmodel
from ..sources.tables import load, series
from .maps import AT, _channels
from .registry import query, r6

_H = "h AS (SELECT event_type AS g, CAST(floor(value / 5) AS BIGINT) AS i, count(*) * 1.0::DOUBLE AS x FROM events GROUP BY ALL)"


def _histogram(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 5).cast("long").alias("i")).agg(F.count("*").cast("double").alias("x"))


@query(
    f"""WITH {_H}, r AS (SELECT *, lag(x) OVER w AS l, lead(x) OVER w AS n FROM h WINDOW w AS (PARTITION BY g ORDER BY i)), s AS (SELECT *, sum(CASE WHEN x < l AND x < n THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY i) AS run FROM r),
    p AS (SELECT g, run, max(x) AS height, first(i ORDER BY x DESC, i) AS peak, min(i) AS a, max(i) AS z FROM s GROUP BY g, run), q AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY g ORDER BY run), z) AS b, max(height) OVER (PARTITION BY g) AS top FROM p),
    f AS (SELECT q.g, peak, height, coalesce(max(s.i) FILTER (s.i < peak AND s.x < 0.5 * height), any_value(a)) AS start, coalesce(min(s.i) FILTER (s.i > peak AND s.x < 0.5 * height), any_value(b)) AS stop FROM q JOIN s ON s.g = q.g AND s.run = q.run WHERE height >= 0.1 * top GROUP BY q.g, peak, height)
    SELECT g AS event_type, peak, height, start, stop, stop - start AS width FROM f"""
)
def peak_widths(spark, sf_dir):
    """Peaks of each type's histogram of values, and their widths at half height."""
    return filters.peak_widths(_histogram(spark, sf_dir), "event_type", "i", "x", least=0.1)


@query(f"WITH {_H} SELECT g AS event_type, first(i ORDER BY x DESC, i) AS frequency, max(x) AS peak FROM h WHERE i BETWEEN 4 AND 12 GROUP BY g")
def peak_within_band(spark, sf_dir):
    return filters.peak_within(_histogram(spark, sf_dir), ["event_type"], "i", "x", 4, 12)


@query(f"WITH {_H}, r AS (SELECT *, lag(x) OVER w AS l, lead(x) OVER w AS n FROM h WINDOW w AS (PARTITION BY g ORDER BY i)) SELECT g AS event_type, first(i ORDER BY x DESC, i) AS frequency, max(x) AS peak FROM r WHERE x > l AND x > n AND i BETWEEN 4 AND 30 GROUP BY g")
def local_peak_within_band(spark, sf_dir):
    return filters.peak_within(_histogram(spark, sf_dir), ["event_type"], "i", "x", 4, 30, local=True)


def _series(spark, sf_dir):
    return series(load(spark, sf_dir, "events"))


@query()
def filtered_in_state(spark, sf_dir):
    """Band-pass and band-stop of users' values, the filter's state carried along and back."""
    s = _series(spark, sf_dir)
    kept = filters.bandpass(s, "user_id", "i", "value", 50, 200).withColumnRenamed("y", "kept")
    return kept.join(filters.bandpass(s, "user_id", "i", "value", 50, 200, stop=True), ["user_id", "i"])


@query()
def nonnegative_filtered(spark, sf_dir):
    return filters.nonnegative_bandpass(_series(spark, sf_dir), "user_id", "i", "value", None, 100)


@query()
def line_noise_removed(spark, sf_dir):
    """Values without a line and its overtones, and without what the users share about it."""
    s = _series(spark, sf_dir)
    own = filters.without_line_noise(s, "user_id", "i", "value").withColumnRenamed("y", "stopped")
    return own.join(filters.without_common_noise(s, "user_id", "i", "value"), ["user_id", "i"])


def _spectra(spark, sf_dir, group):
    df = _channels(spark, sf_dir)
    names = lagmodel.channels(df, AT)
    return co.cross_spectra(df, names, 16, 3, group, AT), names


@query()
def channel_coherence(spark, sf_dir):
    """Squared coherence of all pairs of channels with its p-value, over all users' windows."""
    made, names = _spectra(spark, sf_dir, "all")
    return co.coherence(made, names, 16)


@query()
def trial_coherence(spark, sf_dir):
    """Coherence by place in the series, averaged over users."""
    made, names = _spectra(spark, sf_dir, "place")
    return co.coherence(made, names, 16, group="place").withColumn("coherence", co.corrected(F.col("coherence"), F.col("n")))


@query()
def sliding_coherence(spark, sf_dir):
    """Coherence of every window, from its tapers alone."""
    made, names = _spectra(spark, sf_dir, "window")
    return co.coherence(made, names, 16, group="window")


@query()
def population_coherence(spark, sf_dir):
    """Mean coherence and leading eigenvalue of each user's channels."""
    made, names = _spectra(spark, sf_dir, "trial")
    return co.population(made, names, 16, group="trial").select("trial", "frequency", r6("mean").alias("mean"), r6("eigen").alias("eigen"))
