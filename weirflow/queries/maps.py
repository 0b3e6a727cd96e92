"""Phase maps, cosine transforms and hulls over frames and sets, and filters between channels."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import cosine, hull, lagmodel, phasemap, triangulation as tr
from ..sources.tables import load, series
from .registry import SERIES, query, r6

_G = "g AS (SELECT l_returnflag AS frame, CAST(floor(l_tax / 0.01) AS BIGINT) AS row, CAST(floor(l_quantity / 5) AS BIGINT) AS col, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"
_T = "atan2(sin({0} - {1}), cos({0} - {1}))"


def _frames(spark, sf_dir):
    cell = lambda c, w: F.floor(F.col(c) / F.lit(w)).cast("long")
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("frame"), cell("l_tax", 0.01).alias("row"), cell("l_quantity", 5).alias("col")).agg(F.count("*").cast("double").alias("value"))


def _phases(spark, sf_dir):
    return _frames(spark, sf_dir).withColumn("value", F.col("value") / 4)


_C = f"""{_G}, c AS (SELECT a.frame, a.row, a.col, a.value / 4 AS a, b.value / 4 AS b, c.value / 4 AS c, d.value / 4 AS d FROM g a JOIN g b ON b.frame = a.frame AND b.row = a.row AND b.col = a.col + 1
    JOIN g c ON c.frame = a.frame AND c.row = a.row + 1 AND c.col = a.col JOIN g d ON d.frame = a.frame AND d.row = a.row + 1 AND d.col = a.col + 1),
    w AS (SELECT frame, row, col, CAST(round(({_T.format('b', 'a')} + {_T.format('d', 'b')} + {_T.format('c', 'd')} + {_T.format('a', 'c')}) / (2 * pi())) AS INTEGER) AS winding,
    ({_T.format('b', 'a')} + {_T.format('d', 'c')}) / 2 AS dx, ({_T.format('c', 'a')} + {_T.format('d', 'b')}) / 2 AS dy FROM c)"""


@query(f"WITH {_C} SELECT frame, row, col, winding FROM w")
def winding_numbers(spark, sf_dir):
    return phasemap.winding(phasemap.cells(_phases(spark, sf_dir), by=["frame"])).select("frame", "row", "col", "winding")


@query(
    f"""WITH {_C}, q AS (SELECT a.frame, a.row, a.col, (sign(b.dx) - sign(a.dx)) / 2 AS bx, (sign(c.dy) - sign(a.dy)) / 2 AS wy FROM w a JOIN w b ON b.frame = a.frame AND b.row = a.row AND b.col = a.col + 1
    JOIN w c ON c.frame = a.frame AND c.row = a.row + 1 AND c.col = a.col JOIN w d ON d.frame = a.frame AND d.row = a.row + 1 AND d.col = a.col + 1 WHERE a.winding = 0 AND b.winding = 0 AND c.winding = 0 AND d.winding = 0)
    SELECT frame, CASE WHEN winding > 0 THEN 'clockwise' ELSE 'anticlockwise' END AS kind, row, col FROM w WHERE winding <> 0
    UNION ALL SELECT frame, CASE WHEN bx = -1 AND wy = -1 THEN 'maximum' WHEN bx = 1 AND wy = 1 THEN 'minimum' ELSE 'saddle' END, row, col FROM q WHERE abs(bx * wy) = 1"""
)
def critical_points(spark, sf_dir):
    """Rotations, extrema and saddles of three phase maps."""
    return phasemap.critical_points(_phases(spark, sf_dir), by=["frame"]).select("frame", "kind", "row", "col")


@query()
def critical_places(spark, sf_dir):
    """The same points as places, near ones merged, away from the edge."""
    return phasemap.merged(phasemap.critical_points(_phases(spark, sf_dir), by=["frame"], edge=1), 1.2, ["frame"])


def _wave(k: str, i: str, n: str) -> str:
    return f"sqrt((CASE WHEN {k} = 0 THEN 1.0 ELSE 2.0 END) / {n}) * cos(pi() * (2 * {i} + 1) * {k} / (2.0 * {n}))"


_K = f"""{_G}, s AS (SELECT frame, max(row) + 1 AS h, max(col) + 1 AS w FROM g GROUP BY frame), n AS (SELECT frame, h, w, unnest(range(h)) AS kr FROM s), m AS (SELECT frame, h, w, kr, unnest(range(w)) AS kc FROM n),
    k AS (SELECT m.frame, h, w, kr, kc, sum(value * {_wave('kr', 'row', 'h')} * {_wave('kc', 'col', 'w')}) AS v FROM g JOIN m USING (frame) GROUP BY ALL)"""


@query(f"WITH {_K} SELECT frame, kr AS row, kc AS col, round(v, 6) + 0.0 AS value FROM k")
def cosine_coefficients(spark, sf_dir):
    return cosine.transform(_frames(spark, sf_dir), ["frame"]).select("frame", "row", "col", r6("value").alias("value"))


def _low(fine: int) -> str:
    half = fine // 2
    return f"""z AS (SELECT frame, h, w, kr, kc, v * avg(CASE WHEN pow((kr + a / {fine}.0) / (2.0 * h), 2) + pow((kc + b / {fine}.0) / (2.0 * w), 2) <= pow(1 / 3.3, 2) THEN 1.0 ELSE 0.0 END) AS v FROM k, range({-half}, {half + 1}) x(a), range({-half}, {half + 1}) y(b) GROUP BY frame, h, w, kr, kc, v),
    o AS (SELECT frame, h, w, kr AS row, kc AS col FROM k) SELECT o.frame, o.row, o.col, round(sum(v * {_wave('z.kr', 'o.row', 'o.h')} * {_wave('z.kc', 'o.col', 'o.w')}), 6) + 0.0 AS value FROM o JOIN z USING (frame) GROUP BY ALL"""


@query(f"WITH {_K}, {_low(1)}")
def grid_low_pass(spark, sf_dir):
    return cosine.low_pass(_frames(spark, sf_dir), 3.3, fine=1, by=["frame"]).select("frame", "row", "col", r6("value").alias("value"))


@query(f"WITH {_K}, {_low(7)}")
def grid_low_pass_smooth(spark, sf_dir):
    """Low-pass whose cut is softened by the share of a coefficient's square within it."""
    return cosine.low_pass(_frames(spark, sf_dir), 3.3, fine=7, by=["frame"]).select("frame", "row", "col", r6("value").alias("value"))


def _half(k: str, n: str) -> str:
    return f"(CASE WHEN {k} IN (0, {n} - 1) THEN 0.5 ELSE 1.0 END)"


@query(
    f"""WITH {_G}, s AS (SELECT frame, max(row) + 1 AS h, max(col) + 1 AS w FROM g GROUP BY frame), n AS (SELECT frame, h, w, unnest(range(h)) AS kr FROM s), m AS (SELECT frame, h, w, kr, unnest(range(w)) AS kc FROM n),
    k AS (SELECT m.frame, h, w, kr, kc, sum(value * 4.0 / ((h - 1) * (w - 1)) * {_half('kr', 'h')} * {_half('kc', 'w')} * {_half('row', 'h')} * {_half('col', 'w')} * cos(pi() * kr * row / (h - 1)) * cos(pi() * kc * col / (w - 1))) AS v FROM g JOIN m USING (frame) GROUP BY ALL),
    a AS (SELECT frame, h, w, unnest(range((h - 1) * 3 + 1)) AS row FROM s), o AS (SELECT frame, row, unnest(range((w - 1) * 3 + 1)) AS col FROM a)
    SELECT o.frame, o.row, o.col, round(sum(v * cos(pi() * kr * o.row / (3.0 * (h - 1))) * cos(pi() * kc * o.col / (3.0 * (w - 1)))), 6) + 0.0 AS value FROM o JOIN k USING (frame) GROUP BY ALL"""
)
def grid_up_sampled(spark, sf_dir):
    return cosine.up_sample(_frames(spark, sf_dir), 3, ["frame"]).select("frame", "row", "col", r6("value").alias("value"))


@query()
def grid_compact(spark, sf_dir):
    """Low-passed frames on no more rows and columns than their waves need."""
    return cosine.compact(_frames(spark, sf_dir), 3.3, by=["frame"])


_H = "WITH p AS (SELECT DISTINCT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


@query(f"{_H} SELECT a.label, a.x, a.y, b.x AS next_x, b.y AS next_y FROM p a JOIN p b ON b.label = a.label AND (b.x <> a.x OR b.y <> a.y) WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.label = a.label AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)")
def convex_hulls(spark, sf_dir):
    """Edges of the hull of each label's points: no point lies to the right of one."""
    points = load(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return hull.edges(hull.hulls(points, "label"), "label")


@query(f"WITH {_G}, p AS (SELECT frame, CAST(col AS DOUBLE) AS x, CAST(row AS DOUBLE) AS y FROM g WHERE value > (SELECT avg(value) FROM g) AND (row + col) % 2 = 0), e AS (SELECT a.frame, a.x, a.y, b.x AS next_x, b.y AS next_y FROM p a JOIN p b ON b.frame = a.frame AND (b.x <> a.x OR b.y <> a.y) WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.frame = a.frame AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0))) SELECT * FROM e")
def mask_hulls(spark, sf_dir):
    """Hulls of the cells of three grids that hold more than the mean, on every other cell."""
    grid = _frames(spark, sf_dir)
    mean = grid.agg(F.avg("value")).first()[0]
    held = grid.withColumn("value", (F.col("value") > mean) & ((F.col("row") + F.col("col")) % 2 == 0))
    return hull.edges(hull.mask_hulls(held, "frame"), "frame")


@query()
def resampled_hulls(spark, sf_dir):
    points = load(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return hull.resampled(hull.hulls(points, "label"), "label", 36, 20.0)


_D3 = """WITH p AS (SELECT label, vec_id AS k, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
    t AS (SELECT a.label, a.k AS a, b.k AS b, c.k AS c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS wy, c.x AS cx, c.y AS cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS o FROM p a JOIN p b ON b.label = a.label AND b.k > a.k JOIN p c ON c.label = a.label AND c.k > b.k),
    f AS (SELECT label, a, b, c FROM t WHERE o <> 0 AND NOT EXISTS (SELECT 1 FROM p d WHERE d.label = t.label AND d.k <> t.a AND d.k <> t.b AND d.k <> t.c AND sign(o) * (
        (pow(ax - d.x, 2) + pow(ay - d.y, 2)) * ((bx - d.x) * (cy - d.y) - (cx - d.x) * (wy - d.y)) - (pow(bx - d.x, 2) + pow(wy - d.y, 2)) * ((ax - d.x) * (cy - d.y) - (cx - d.x) * (ay - d.y)) + (pow(cx - d.x, 2) + pow(cy - d.y, 2)) * ((ax - d.x) * (wy - d.y) - (bx - d.x) * (ay - d.y))) > 0))"""


def _triangles(spark, sf_dir):
    points = load(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return tr.delaunay(points, "label", "vec_id", per_tile=16)


@query(f"{_D3} SELECT * FROM f")
def delaunay_triangles(spark, sf_dir):
    """Triangles of each label's points whose circle holds no other point."""
    return _triangles(spark, sf_dir)


@query(f"{_D3}, e AS (SELECT label, a AS p, b AS q FROM f UNION ALL SELECT label, b, c FROM f UNION ALL SELECT label, a, c FROM f) SELECT label, p, q, count(*) AS n FROM e GROUP BY label, p, q")
def delaunay_edges(spark, sf_dir):
    return tr.edges(_triangles(spark, sf_dir), "label")


AT = lagmodel.Layout("user_id", "channel", "i", "value")


def _channels(spark, sf_dir):
    """Events of each type as channels of a user's series, and their values as one more."""
    s = series(load(spark, sf_dir, "events"))
    return s.select("user_id", "i", F.col("event_type").alias("channel"), F.lit(1.0).alias("value")).unionByName(s.select("user_id", "i", F.lit("~value").alias("channel"), "value"))


_D = f"{SERIES}, x AS (SELECT user_id, i, event_type AS channel, 1.0::DOUBLE AS v FROM s UNION ALL SELECT user_id, i, '~value', value FROM s), m AS (SELECT channel, sum(v) / (SELECT count(*) FROM s) AS m FROM x GROUP BY channel), d AS (SELECT s.user_id, s.i, m.channel, coalesce(x.v, 0) - m AS v FROM s CROSS JOIN m LEFT JOIN x ON x.user_id = s.user_id AND x.i = s.i AND x.channel = m.channel)"


@query(f"{_D} SELECT a.channel AS earlier, b.channel AS later, lag, round(sum(a.v * b.v), 2) + 0.0 AS product FROM d a CROSS JOIN range(0, 4) l(lag) JOIN d b ON b.user_id = a.user_id AND b.i = a.i + lag GROUP BY ALL")
def block_lag_products(spark, sf_dir):
    """Lag products of all pairs of channels, less their means: what the normal equations of filters are made of."""
    df = _channels(spark, sf_dir)
    names = lagmodel.channels(df, AT)
    c = lagmodel.lag_products(df, names, 3, lagmodel.channel_means(df, names, AT), at=AT)
    rows = [(a, b, d, float(c[i, j, d])) for i, a in enumerate(names) for j, b in enumerate(names) for d in range(4)]
    return spark.createDataFrame(rows, "earlier string, later string, lag long, product double").withColumn("product", F.round("product", 2) + 0.0)


_W = {"click": (0.5, 1.0, -0.25), "view": (0.125, 0.0, 2.0)}


@query(
    f"{SERIES}, w AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {k - 1}, {w}::DOUBLE)" for c, row in _W.items() for k, w in enumerate(row)) + ") t(channel, lag, w))"
    " SELECT s.user_id, s.i, round(coalesce(sum(w), 0), 6) + 0.0 AS fitted FROM s LEFT JOIN (SELECT x.user_id, x.i + lag AS i, w FROM s x JOIN w ON w.channel = x.event_type) f ON f.user_id = s.user_id AND f.i = s.i GROUP BY s.user_id, s.i"
)
def chunk_filtered(spark, sf_dir):
    """Filters of three lags applied to two channels in chunks of eight samples."""
    model = lagmodel.Filters(tuple(_W), -1, np.array(list(_W.values())), np.zeros(2), 0.0)
    made = lagmodel.apply(_channels(spark, sf_dir), model, 8, AT)
    return made.select(F.col("trial").alias("user_id"), F.col("t").alias("i"), r6("fitted").alias("fitted"))


@query()
def lag_filters(spark, sf_dir):
    """Filters of the event types onto the values, by lag products and by cross-spectra."""
    df, rows = _channels(spark, sf_dir), []
    for how, model in (("time", lagmodel.fit(df, "~value", -2, 2, 1e-3, at=AT)), ("frequency", lagmodel.spectral_fit(df, "~value", 16, 1e-3, AT))):
        rows += [(how, c, model.first + k, float(w)) for c, row in zip(model.inputs, model.weights, strict=True) for k, w in enumerate(row)]
    return spark.createDataFrame(rows, "how string, channel string, lag long, weight double")


@query()
def lag_reconstruction(spark, sf_dir):
    """Values rebuilt from the event types about them."""
    df = _channels(spark, sf_dir)
    return lagmodel.apply(df, lagmodel.fit(df, "~value", -2, 2, 1e-3, at=AT), at=AT)
