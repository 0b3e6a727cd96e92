"""Grids, point sets and graphs."""

from pyspark.sql import functions as F

from ..operators import grid as g
from ..sources.tables import load
from .registry import query, r6

_G = "g AS (SELECT CAST(floor(l_tax / 0.01) AS BIGINT) AS row, CAST(floor(l_quantity / 5) AS BIGINT) AS col, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"


def _grid(spark, sf_dir):
    cell = lambda c, w: F.floor(F.col(c) / F.lit(w)).cast("long")
    return load(spark, sf_dir, "lineitem").groupBy(cell("l_tax", 0.01).alias("row"), cell("l_quantity", 5).alias("col")).agg(F.count("*").cast("double").alias("value"))


@query(f"WITH {_G} SELECT a.row, a.col, coalesce(sum(b.value), 0) - count(b.value) * any_value(a.value) AS laplacian FROM g a LEFT JOIN g b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY a.row, a.col")
def grid_laplacian(spark, sf_dir):
    return g.laplacian(_grid(spark, sf_dir))


@query(f"WITH {_G} SELECT a.row, a.col, any_value(a.value) AS value FROM g a LEFT JOIN g b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) GROUP BY a.row, a.col HAVING any_value(a.value) > CASE WHEN count(b.value) < 8 THEN greatest(coalesce(max(b.value), 0), 0) ELSE max(b.value) END")
def local_peaks_grid(spark, sf_dir):
    return g.find_peaks(_grid(spark, sf_dir))


@query(f"WITH {_G} SELECT a.row, a.col, any_value(a.value) AS value FROM g a LEFT JOIN g b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 AND (a.row <> b.row OR a.col <> b.col) GROUP BY a.row, a.col HAVING count(b.value) = 0 OR any_value(a.value) >= max(b.value)")
def local_peaks_weak(spark, sf_dir):
    return g.find_peaks(_grid(spark, sf_dir), r=2, strict=False)


@query(f"WITH {_G}, h AS (SELECT * FROM g WHERE (row + col) % 4 <> 0) SELECT c.row, c.col, round(coalesce(h.value, m.mean), 6) AS value FROM g c LEFT JOIN h USING (row, col) LEFT JOIN (SELECT c.row, c.col, avg(b.value) AS mean FROM g c JOIN h b ON abs(c.row - b.row) + abs(c.col - b.col) = 1 GROUP BY c.row, c.col) m USING (row, col)")
def grid_fill(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    return g.fill_missing(grid.where("(row + col) % 4 != 0"), grid.select("row", "col")).select("row", "col", r6("value").alias("value"))


@query(f"WITH {_G}, h AS (SELECT * FROM g WHERE row BETWEEN 2 AND 5 AND col > 3) SELECT row - min(row) OVER () AS row, col - min(col) OVER () AS col, value FROM h")
def grid_trim(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    return g.trim(grid.withColumn("value", F.when(F.col("row").between(2, 5) & (F.col("col") > 3), F.col("value"))))


_T = "atan2(sin({0} - {1}), cos({0} - {1}))"


@query(
    f"""WITH {_G}, p AS (SELECT row, col, value / 100 AS v FROM g),
    q AS (SELECT a.row, a.col, ({_T.format('x.v', 'a.v')} + {_T.format('d.v', 'y.v')}) / 2 AS dx, ({_T.format('y.v', 'a.v')} + {_T.format('d.v', 'x.v')}) / 2 AS dy
    FROM p a JOIN p x ON x.row = a.row AND x.col = a.col + 1 JOIN p y ON y.row = a.row + 1 AND y.col = a.col JOIN p d ON d.row = a.row + 1 AND d.col = a.col + 1)
    SELECT round(sqrt(pow(avg(dx), 2) + pow(avg(dy), 2)), 6) AS planar, round(avg(sqrt(dx * dx + dy * dy)), 6) AS local, round(sqrt(pow(avg(dx), 2) + pow(avg(dy), 2)) / avg(sqrt(dx * dx + dy * dy)), 6) AS pgd FROM q"""
)
def phase_gradient_directionality(spark, sf_dir):
    phases = _grid(spark, sf_dir).withColumn("value", F.col("value") / 100)
    made = g.directionality(g.phase_gradient(phases))
    return made.select(*(r6(c).alias(c) for c in made.columns))


_SEEDS = ((0.0, 0.0), (0.1, 0.1), (-0.1, 0.1), (0.1, -0.1), (-0.1, -0.1))
_V = "v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_NEAR = "list_position(d, list_min(d)) - 1 AS region FROM (SELECT *, [" + ", ".join(f"pow(x - {a}, 2) + pow(y - {b}, 2)" for a, b in _SEEDS) + "] AS d FROM v)"


def _points(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(f"WITH {_V} SELECT vec_id, CAST({_NEAR.replace(' AS region', ' AS BIGINT) AS region')}")
def nearest_region(spark, sf_dir):
    return g.assign_regions(_points(spark, sf_dir), _SEEDS).select("vec_id", F.col("region").cast("long").alias("region"))


@query(f"WITH {_V} SELECT CAST(region AS BIGINT) AS region, count(*) AS n, round(avg(x), 6) + 0.0 AS mx, round(avg(y), 6) + 0.0 AS my, round(var_pop(x), 6) AS vx, round(var_pop(y), 6) AS vy, round(covar_pop(x, y), 6) + 0.0 AS vxy FROM (SELECT x, y, {_NEAR}) GROUP BY 1")
def region_gaussians(spark, sf_dir):
    made = g.gaussians(g.assign_regions(_points(spark, sf_dir), _SEEDS), "region")
    return made.select(F.col("region").cast("long").alias("region"), "n", *(r6(c).alias(c) for c in ("mx", "my", "vx", "vy", "vxy")))


@query(f"WITH {_V} SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 0.0001")
def near_pairs(spark, sf_dir):
    return g.near_pairs(_points(spark, sf_dir), "vec_id", 0.01)


@query(f"WITH {_V}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 0.0025) SELECT a, b, round(sqrt(d), 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1")
def nearest_neighbour(spark, sf_dir):
    _checkpoints(spark)
    made = g.nearest(_points(spark, sf_dir), "vec_id", 0.05)
    return made.select("a", "b", r6("distance").alias("distance"))


@query(f"WITH RECURSIVE {_V}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 0.00004), w AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node WHERE w.root < e.b) SELECT node, min(root) AS root FROM w GROUP BY node")
def connected_components(spark, sf_dir):
    _checkpoints(spark)
    return g.components(g.near_links(_points(spark, sf_dir), "vec_id", 0.00004**0.5))


@query()
def mutual_matching(spark, sf_dir):
    _checkpoints(spark)
    points = _points(spark, sf_dir)
    near = g.near_pairs(points, "vec_id", 0.02).select("a", "b")
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = load(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).alias("left"))
    left, right = (side.where(F.col("left") == on).select(F.col("vec_id").alias(n)) for n, on in (("a", True), ("b", False)))
    pairs = near.join(left, "a", "left_semi").join(right, "b", "left_semi")
    at = lambda n: points.select(F.col("vec_id").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    rows = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2)).alias("distance"))
    return g.mutual_pairs(points, points, rows)


def _checkpoints(spark):
    from ..plans.store import checkpoint_folder

    checkpoint_folder(spark)


@query(f"WITH {_V} SELECT vec_id FROM v WHERE x + y <= 0.1 AND x >= -0.1 AND y >= -0.1")
def points_in_hull(spark, sf_dir):
    inside = g.in_hull(F.col("x"), F.col("y"), ((-0.1, -0.1), (0.2, -0.1), (-0.1, 0.2)))
    return _points(spark, sf_dir).where(inside).select("vec_id")
