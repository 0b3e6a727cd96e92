"""Alignment and synchrony, array forms and colours."""

from pyspark.sql import functions as F

from ..functions import colour
from ..operators import alignment as al, factors, vectors as v
from ..sources.tables import load
from .registry import query, r6, r6_up

_X = "x AS (SELECT vec_id, label, k, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(k)), m AS (SELECT label, k, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY label, k), o AS (SELECT k, avg(v) AS o FROM x GROUP BY k), d AS (SELECT label, k, m - o AS d, s FROM m JOIN o USING (k)), z AS (SELECT label, sqrt(sum(d * d)) AS z, avg(s) AS mean FROM d GROUP BY label)"


@query(f"WITH {_X}, p AS (SELECT x.label, x.vec_id, sum(v * d) / any_value(z) AS a FROM x JOIN d USING (label, k) JOIN z USING (label) GROUP BY x.label, x.vec_id) SELECT p.label, round(var_pop(a), 6) AS along, round(any_value(mean), 6) AS mean, round(var_pop(a) / any_value(mean), 4) AS ratio FROM p JOIN z USING (label) GROUP BY p.label")
def overlap_ratio(spark, sf_dir):
    """Variance of each label's vectors along the way from the mean of all to the label's, over that of any axis."""
    rows = load(spark, sf_dir, "embeddings")
    long = rows.select("label", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    own = long.groupBy("label", "k").agg(F.avg("x").alias("m")).join(long.groupBy("k").agg(F.avg("x").alias("o")), "k")
    ways = own.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", (F.col("m") - F.col("o")).alias("d")))), lambda s: s["d"]).alias("way"))
    made = al.overlap_ratio(rows.join(ways, "label"), "embedding", F.col("way"), ["label"])
    return made.select("label", r6("along").alias("along"), r6("mean").alias("mean"), F.round("ratio", 4).alias("ratio"))


@query()
def alignment_chance(spark, sf_dir):
    """Alignment of each label's shift with the covariance within it, against a thousand random directions."""
    rows = load(spark, sf_dir, "embeddings")
    _, centre, _ = factors.vector_moments(rows, "embedding")
    found = factors.grouped_moments(rows, "embedding", ["label"])
    drawn = None
    for (label,), (_, mean, cov) in sorted(found.items()):
        seen = al.alignment(mean - centre, cov)
        one = al.drawn_alignments(spark, cov, 1000, seed=int(label)).select(F.lit(label).alias("label"), F.lit(seen).alias("alignment"), F.lit(al.angle(mean - centre, cov)).alias("angle"), F.col("alignment").alias("chance"))
        drawn = one if drawn is None else drawn.unionByName(one)
    return drawn.groupBy("label", "alignment", "angle").agg(F.percentile("chance", 0.95).alias("chance_95"), ((F.sum((F.col("chance") >= F.col("alignment")).cast("int")) + 1) / (F.count("chance") + 1)).alias("p_value"))


_S = """p AS (SELECT s_nationkey AS unit, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) // 28 AS t, atan2(avg(l_discount) - 0.05, avg(l_tax) - 0.04) AS h FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    n AS (SELECT n_nationkey AS unit, n_regionkey * 1.0::DOUBLE AS x, (n_nationkey % 5) * 1.0::DOUBLE AS y FROM nation), q AS (SELECT sqrt(pow(m.x - n.x, 2) + pow(m.y - n.y, 2)) AS d, abs(cos(a.h - b.h)) AS c FROM p a JOIN p b ON b.t = a.t AND a.unit < b.unit JOIN n m ON m.unit = a.unit JOIN n ON n.unit = b.unit),
    b AS (SELECT CAST(floor(d + 0.5) AS BIGINT) AS bin, avg(d) AS distance, avg(c) AS synchrony, count(*) AS n FROM q GROUP BY 1)"""


def _binned(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    t = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) / 28)
    phases = items.groupBy(F.col("s_nationkey").alias("unit"), t.alias("t")).agg(F.atan2(F.avg("l_discount") - 0.05, F.avg("l_tax") - 0.04).alias("h"))
    places = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").cast("double").alias("x"), (F.col("n_nationkey") % 5).cast("double").alias("y"))
    return al.synchrony_by_distance(phases, places, "unit", "t", "h", 1.0)


@query(f"WITH {_S} SELECT bin, round(distance, 6) AS distance, round(synchrony, 6) AS synchrony, n FROM b")
def synchrony_by_distance(spark, sf_dir):
    """Synchrony of nations' monthly mixes of discount and tax by how far apart they lie on a map."""
    return _binned(spark, sf_dir).select("bin", r6("distance").alias("distance"), r6("synchrony").alias("synchrony"), "n")


@query(f"WITH {_S} SELECT bin, round(distance / -ln(synchrony + 1e-6), 6) AS length FROM b WHERE distance > 0 AND synchrony > 0")
def length_constants(spark, sf_dir):
    return al.length_constants(_binned(spark, sf_dir)).select("bin", r6("length").alias("length"))


_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_LIST = "list_transform(range(1, 65), lambda k: {})"


@query(
    f"WITH {_E}, f AS (SELECT vec_id, e, list_reverse(e) AS r FROM e) SELECT vec_id, "
    + ", ".join(f"round(list_sum({_LIST.format(t)}), 6) + 0.0 AS {n}" for n, t in {"sums": "abs(e[k] + r[k])", "difs": "abs(e[k] - r[k])", "muls": "abs(e[k] * r[k])", "combined": "abs(2 * e[k] - 3 * r[k])", "held": "CASE WHEN e[k] >= -0.1 AND e[k] < 0.05 THEN e[k] ELSE 0 END"}.items())
    + ", "
    + ", ".join(f"list_sum({_LIST.format(t)}) AS {n}" for n, t in {"lt": "(e[k] < 0.05)::INT", "ge": "(e[k] >= 0.05)::INT", "ne": "(e[k] <> r[k])::INT", "within_": "(e[k] >= -0.1 AND e[k] < 0.05)::INT", "both": "(e[k] * 20 + r[k] * 20 >= 2)::INT", "neither": "(e[k] * 20 + r[k] * 20 <= 0)::INT", "yes": "(e[k] * 10 >= 1)::INT"}.items())
    + " FROM f"
)
def array_forms(spark, sf_dir):
    """Arithmetic, comparisons and ranges element by element, as their sums."""
    e, r = F.col("e"), F.reverse("e")
    size = lambda a: r6(v.total(F.transform(a, F.abs)))
    ones = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rows.select(
        "vec_id", *(size(v.paired(e, r, k)).alias(f"{k}s") for k in ("sum", "dif", "mul")), size(v.linear_combination(e, r, 2.0, -3.0)).alias("combined"), r6(v.total(v.zeroed_outside(e, -0.1, 0.05))).alias("held"),
        *(ones(v.compared(e, 0.05, k)).alias(k) for k in ("lt", "ge")), ones(v.compared(v.paired(e, r, "dif"), 0.0, "ne")).alias("ne"), ones(v.within(e, -0.1, 0.05)).alias("within_"),
        ones(v.paired(v.scaled(e, 20.0), v.scaled(r, 20.0), "and")).alias("both"), ones(v.paired(v.scaled(e, 20.0), v.scaled(r, 20.0), "nor")).alias("neither"), ones(v.truth(v.scaled(e, 10.0))).alias("yes"),
    )


@query(
    f"WITH {_E} SELECT vec_id, round(list_stddev_pop(e), 6) AS std, round(list_stddev_samp(e), 6) AS sstd, round(list_stddev_samp(e) / 8, 6) AS sem, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS squares, round(list_sum(list_transform(e, lambda x: pow(x - 0.25, 2))), 6) AS apart,"
    " round((list_sum(list_transform(range(1, 65), lambda k: e[k] * e[65 - k])) - 64 * pow(list_avg(e), 2)) / 63, 6) + 0.0 AS scov, round(list_var_pop(e[1:8]), 6) AS first_row, round(list_max(e) - list_min(e), 6) AS widest, 7 AS pieces FROM e"
)
def array_statistics(spark, sf_dir):
    """Deviations, standard errors, covariances and rows of arrays cut in pieces."""
    e = F.col("e")
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rows.select(
        "vec_id", r6(v.deviation(e)).alias("std"), r6(v.deviation(e, True)).alias("sstd"), r6(v.standard_error(e)).alias("sem"), r6(v.squared_magnitude(e)).alias("squares"), r6(v.total(v.squared_deviations(e, F.lit(0.25)))).alias("apart"),
        r6(v.covariance(e, F.reverse("e"), True)).alias("scov"), r6(v.per_row(v.cut(e, 8), "var")[0]).alias("first_row"), r6(F.array_max(F.flatten(v.all_differences(e)))).alias("widest"), v.divided_up(F.size(e), F.lit(10)).alias("pieces"),
    )


@query(f"WITH {_E} SELECT q.vec_id AS query, e.vec_id AS t, round(list_distance(e.e, q.e) / 8, 5) + 0.0 AS value FROM e, e q")
def time_distances(spark, sf_dir):
    """Root mean squared difference of every vector with every one."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    made = v.time_distances(rows.withColumnRenamed("vec_id", "t"), "t", "e", rows.withColumnRenamed("vec_id", "t"))
    return made.select("query", "t", (F.round("value", 5) + 0.0).alias("value"))


_HSV = "SELECT event_id, h, f, floor(h / 60) % 6 AS k, v, v * (1 - s) AS p, v * (1 - f * s) AS q, v * (1 - (1 - f) * s) AS t FROM (SELECT event_id, h, s, v, h / 60 - floor(h / 60) AS f FROM (SELECT event_id, (event_id * 7 % 360) * 1.0::DOUBLE AS h, (event_id % 11) / 10.0::DOUBLE AS s, (user_id % 13) / 12.0::DOUBLE AS v FROM events))"


@query(
    f"WITH c AS (SELECT event_id, [v, q, p, p, t, v][k::INT + 1] AS r, [t, v, v, q, p, p][k::INT + 1] AS g, [p, p, t, v, v, q][k::INT + 1] AS b FROM ({_HSV}))"
    " SELECT event_id, round(r + 3e-10, 6) AS r, round(g + 3e-10, 6) AS g, round(b + 3e-10, 6) AS b, round(sqrt(pow((2 * r - g - b) / 2, 2) + 0.75 * pow(g - b, 2)) + 3e-10, 6) AS chroma, round(0.299 * r + 0.587 * g + 0.114 * b + 3e-10, 6) AS light, round((r + g + b) / 3 + (r - (r + g + b) / 3) * cos(1) + (b - g) * sin(1) / sqrt(3) + 3e-10, 6) + 0.0 AS turned FROM c"
)
def colour_spaces(spark, sf_dir):
    """Hue, saturation and value to red, green and blue, on to chroma and luminance, and turned about grey."""
    events = load(spark, sf_dir, "events")
    rgb = colour.hsv_to_rgb((F.col("event_id") * 7 % 360).cast("double"), (F.col("event_id") % 11) / 10.0, (F.col("user_id") % 13) / 12.0)
    rows = events.select("event_id", *(c.alias(n) for c, n in zip(rgb, "rgb", strict=True)))
    cols = [F.col(c) for c in "rgb"]
    hcl = colour.rgb_to_hcl(*cols)
    return rows.select("event_id", *(r6_up(c).alias(c) for c in "rgb"), r6_up(hcl[1]).alias("chroma"), r6_up(hcl[2]).alias("light"), r6_up(colour.rotated(*cols, F.lit(1.0))[0]).alias("turned"))


@query()
def colour_matched(spark, sf_dir):
    """Colours moved to one luminance, and how far their hue went."""
    c = [((F.col("event_id") * k) % 97) / 96.0 for k in (3, 7, 11)]
    moved = colour.matched_luminance(*c, F.lit(0.5))
    return load(spark, sf_dir, "events").select("event_id", colour.lightness(*moved).alias("light"), colour.hue_angle(moved, c).alias("turned"))
