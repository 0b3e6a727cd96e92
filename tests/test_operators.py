"""Edge cases of operators on hand-written rows."""

import math

import pytest
from pyspark.sql import functions as F

from weirflow.functions import scalar, text
from weirflow.operators import binning, events, grid, information, intervals, linmodel, multitest, normalize, resample, summary, windows
from weirflow.plans.joins import band_join, spine
from weirflow.plans.store import cached, checkpoint_folder, key_of, parallel_map
from weirflow.sources import files


def series(spark, values, kind="double"):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], f"k string, i long, x {kind}")


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize(("counts", "bits"), [([1, 1], 1), ([1, 1, 1, 1], 2), ([2, 1, 1], 1.5)])
def test_entropy_values(spark, counts, bits):
    df = spark.createDataFrame([(i, float(n)) for i, n in enumerate(counts)], "x int, n double")
    assert information.entropy(df, ["x"]).first().h == pytest.approx(bits * math.log(2))


@pytest.mark.parametrize(("rows", "bits"), [([[1, 1, 1, 1], [1, 1, 1, 1], [2, 2, 2, 2]], 0), ([[1, 1, 2, 4], [1, 2, 4, 1], [2, 4, 1, 1], [4, 1, 1, 2]], 0.25)])
def test_mutual_information_values(spark, rows, bits):
    df = spark.createDataFrame([(i, j, float(n)) for i, r in enumerate(rows) for j, n in enumerate(r)], "x int, y int, n double")
    assert information.mutual_information(df, ["x"], ["y"]).first().mi == pytest.approx(bits * math.log(2), abs=1e-12)


def test_conditional_entropy_values(spark):
    df = spark.createDataFrame([(i, j, float(n)) for i, r in enumerate([[1] * 4, [1] * 4, [2] * 4]) for j, n in enumerate(r)], "x int, y int, n double")
    assert information.conditional_entropy(df, ["x"], ["y"]).first().h == pytest.approx(1.5 * math.log(2))
    assert information.conditional_entropy(df, ["y"], ["x"]).first().h == pytest.approx(2 * math.log(2))


def test_interpolation_and_legacy(spark):
    df = series(spark, [None, 1.0, None, None, 4.0, None])
    assert column(intervals.interpolate_gaps(df, "x", "k", "i", "y"), "y") == [None, 1.0, 2.0, 3.0, 4.0, None]
    assert column(intervals.interpolate_gaps(df, "x", "k", "i", "y", legacy=True), "y") == [None, 1.0, 1.0, 2.5, 4.0, None]


def test_dilation_reach(spark):
    df = series(spark, [i == 10 for i in range(21)], "boolean")
    wide = column(df.select("i", intervals.dilate("x", "k", "i", 3, legacy=True).alias("y")), "y")
    assert sum(wide) == 13
    assert sum(column(df.select("i", intervals.dilate("x", "k", "i", 3).alias("y")), "y")) == 7


def test_plateau_is_flagged_at_both_ends(spark):
    df = series(spark, [0.0, 2.0, 2.0, 1.0])
    assert column(df.select("i", windows.local_maxima("x", "k", "i").alias("y")), "y") == [False, True, True, False]


def test_box_filter_clamps_and_reflects(spark):
    df = series(spark, [1.0, 2.0, 4.0])
    got = column(windows.box_filter(df, "x", "k", "i", 3, "y", mode="clamp"), "y")
    assert got == pytest.approx([4 / 3, 7 / 3, 10 / 3])
    assert column(windows.box_filter(df, "x", "k", "i", 3, "y"), "y") == pytest.approx([5 / 3, 7 / 3, 8 / 3])


def test_ranks_pass_over_nulls_and_share_ties(spark):
    df = series(spark, [3.0, None, 1.0, 3.0])
    assert column(df.select("i", normalize.average_rank("x", "k").alias("y")), "y") == [2.5, None, 1.0, 2.5]
    assert column(df.select("i", normalize.uniformize("x", "k").alias("y")), "y") == pytest.approx([2 / 3, None, 0.5 / 3, 2 / 3])


@pytest.mark.parametrize("method", sorted(normalize.METHODS))
def test_normalize_dispatch(spark, method):
    df = series(spark, [1.0, 5.0, 2.0, float("nan"), 7.0])
    got = column(normalize.normalize(df, "x", "k", method, "y"), "y")
    assert got[3] is None and all(v is not None for k, v in enumerate(got) if k != 3)


@pytest.mark.parametrize(("p", "z"), [(0.5, 0.0), (0.975, 1.959963984540054), (0.001, -3.090232306167813)])
def test_normal_quantile(spark, p, z):
    assert spark.range(1).select(scalar.ndtri(F.lit(p)).alias("z")).first().z == pytest.approx(z, abs=1e-7)


@pytest.mark.parametrize("k", [0, 1, 20, 21, 170])
def test_log_factorial(spark, k):
    assert spark.range(1).select(scalar.log_factorial(F.lit(k)).alias("z")).first().z == pytest.approx(math.lgamma(k + 1), rel=1e-10, abs=1e-12)


def test_band_join_equals_all_pairs(spark):
    a = spark.createDataFrame([(i, float(i * 7 % 50)) for i in range(40)], "a long, ta double")
    b = spark.createDataFrame([(i, float(i * 11 % 53)) for i in range(40)], "b long, tb double")
    for low, high in ((-3.0, 5.0), (0.0, 0.5), (2.0, 40.0), (-9.0, -4.0)):
        got = {(r.a, r.b) for r in band_join(a, b, "ta", "tb", low, high).collect()}
        assert got == {(r.a, q.b) for r in a.collect() for q in b.collect() if low <= q.tb - r.ta < high}


def test_empty_bins_and_right_end(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,), (7.0,)], "x double")
    assert [r.n for r in binning.histogram(df, "x", 0, 1, 4).orderBy("bin").collect()] == [1, 0, 0, 1]
    assert [r.n for r in binning.histogram(df, "x", 0, 1, 4, clamp=True).orderBy("bin").collect()] == [1, 0, 0, 2]
    assert spine(df.limit(0).selectExpr("0L AS bin", "0L AS n"), "bin", 0, 3, {"n": 0}).count() == 3


def test_bilinear_total_is_the_points(spark):
    df = spark.createDataFrame([(0.13, 0.9), (1.0, 1.0), (0.0, 0.5), (None, 0.1)], "x double, y double")
    assert binning.bilinear_histogram(df, "x", "y", 7).agg(F.sum("total")).first()[0] == pytest.approx(3)


def test_greedy_thinning(spark):
    df = spark.createDataFrame([(u, t, n) for u in ("a", "b") for n, t in enumerate((0, 3, 5, 9, 10, 15))], "u string, t long, n long")
    got = sorted((r.u, r.t) for r in events.thin(df, "u", "t", "n", 5).collect())
    assert got == [(u, t) for u in ("a", "b") for t in (0, 5, 10, 15)]


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([(0, p) for p in (0.01, 0.04, 0.03, 0.2, None)], "f int, p double")
    got = {r.p: r.p_adjusted for r in multitest.benjamini_hochberg(df, "p", "f").collect()}
    assert got[0.01] == pytest.approx(0.04) and got[0.03] == pytest.approx(0.16 / 3) and got[0.04] == pytest.approx(0.16 / 3) and got[0.2] == pytest.approx(0.2) and got[None] is None


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(500)], "id long, x double")
    r = resample.interval(resample.bootstrap_mean(df, "x", "id", 200, seed=1), "mean").first()
    assert r.low < 4.5 < r.high and r.high - r.low < 1
    again = resample.interval(resample.bootstrap_mean(df.repartition(7), "x", "id", 200, seed=1), "mean").first()
    assert r.low == pytest.approx(again.low)


def test_permutation_tells_groups_apart(spark):
    df = spark.createDataFrame([(i, float(i % 2) + (i % 7) / 100) for i in range(200)], "id long, x double")
    assert resample.permutation_test(df, "x", F.col("id") % 2 == 0, "id", 200).first().p < 0.02
    assert resample.permutation_test(df, "x", F.col("id") < 0, "id", 200).first().p is None


def test_models_recover_weights(spark):
    df = spark.range(2000).select((F.col("id") % 20 / 10).alias("x"), (F.col("id") % 7).cast("double").alias("z"), F.col("id"))
    exact = df.withColumn("y", 2 + 3 * F.col("x") - F.col("z")).withColumn("one", F.lit(1.0))
    ((g, c, _, _),) = linmodel.gram(exact, ["one", "x", "z"], "y").values()
    assert linmodel.ridge(g, c) == pytest.approx([2, 3, -1], abs=1e-5)
    rate = df.withColumn("y", F.exp(0.5 + 0.8 * F.col("x")))
    assert linmodel.poisson_glm(rate, ["x"], "y") == pytest.approx([0.5, 0.8], abs=1e-6)
    share = df.withColumn("y", 1 / (1 + F.exp(1 - 2 * F.col("x"))))
    assert linmodel.logistic_glm(share, ["x"], "y") == pytest.approx([-1, 2], abs=1e-5)
    found = linmodel.circular_regression(df.withColumn("y", 1 + 2 * F.cos(F.col("id") / 10 - 0.7)).withColumn("t", F.col("id") / 10), "t", "y")[()]
    assert found["phase"] == pytest.approx(0.7, abs=1e-6) and found["depth"] == pytest.approx(2, abs=1e-6) and found["r2"] == pytest.approx(1, abs=1e-9)


def test_components_of_a_chain(spark):
    checkpoint_folder(spark)
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.root for r in grid.components(edges).collect()} == {0, 100}


def test_hull_and_regions(spark):
    df = spark.createDataFrame([(0.5, 0.5), (2.0, 0.0), (0.0, 0.0)], "x double, y double")
    square = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))
    assert [r.y for r in df.select(grid.in_hull(F.col("x"), F.col("y"), square).alias("y")).collect()] == [True, False, True]
    assert [r.region for r in grid.assign_regions(df, ((0.0, 0.0), (1.0, 1.0))).collect()] == [0, 1, 0]


def test_text_functions(spark):
    one = spark.range(1)
    assert one.select(text.camel_to_snake(F.lit("getHTTPResponseCode"))).first()[0] == "get_http_response_code"
    assert one.select(text.snake_to_camel(F.lit("get_http code"))).first()[0] == "getHttpCode"
    assert one.select(text.word_wrap(F.lit("aa bb cccccccc d"), 5)).first()[0] == "aa bb\ncccccccc\nd"
    assert one.select(text.short_scientific(F.lit(0.00003))).first()[0] == "3e-5"
    assert one.select(scalar.survey_bearing(F.lit(225.0))).first()[0] == "S45°W"
    assert one.select(scalar.round_significant(F.lit(1234.0), 2)).first()[0] == 1200.0


def test_summary_edges(spark):
    df = spark.createDataFrame([(float(v), v % 2) for v in range(10)], "x double, g int")
    assert summary.cohen_d(df, "x", F.col("g") == 1).first().label == "Medium"
    assert summary.weighted_avg_and_std(df.withColumn("w", F.lit(2.0)), "x", "w").first().mean == pytest.approx(4.5)
    assert summary.describe(df.limit(0), "x").first().n == 0


def test_store_reuses_and_parallel_map_reports(spark, tmp_path):
    df = spark.range(5).withColumn("y", F.col("id") * 2)
    assert key_of("a", df, x=1, y=2) == key_of("a", df, y=2, x=1) != key_of("a", df, x=2, y=2)
    first = cached(df, f"file://{tmp_path}", "t", v=1).collect()
    assert sorted(cached(df, f"file://{tmp_path}", "t", v=1).collect()) == sorted(first)
    rows = parallel_map(spark, lambda v: (1 / v,), [1, 0, 4], "y double").orderBy("task").collect()
    assert [r.y for r in rows] == [1.0, None, 0.25] and rows[1].error.startswith("ZeroDivisionError")


def test_files(spark, tmp_path):
    (tmp_path / "a.frm").write_text("1 2\n3 4\n\n5 6\n7 8\n")
    got = sorted(map(tuple, files.read_frames(spark, f"file://{tmp_path}/a.frm").collect()))
    assert got == [(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 1, 0, 3.0), (0, 1, 1, 4.0), (1, 0, 0, 5.0), (1, 0, 1, 6.0), (1, 1, 0, 7.0), (1, 1, 1, 8.0)]
    assert [r.name for r in files.list_files(spark, f"file://{tmp_path}", "frm").collect()] == ["a.frm"]
    with pytest.raises(ValueError):
        files.check_mat_names(spark.range(1).withColumnRenamed("id", "x" * 32))
    with pytest.raises(NotImplementedError):
        files.read_hdf("x")


def test_mat_reader(spark, tmp_path):
    import struct

    values = struct.pack("<6d", 1, 2, 3, 4, 5, 6)
    name = b"abc"
    body = struct.pack("<IIII", 6, 8, 6, 0) + struct.pack("<IIii", 5, 8, 2, 3) + struct.pack("<HH", 1, 3) + name + b"\0" + struct.pack("<II", 9, 48) + values
    data = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + struct.pack("<II", 14, len(body)) + body
    (tmp_path / "a.mat").write_bytes(data)
    got = sorted((r.row, r.col, r.value) for r in files.read_mat(spark, f"file://{tmp_path}/a.mat").collect())
    assert got == [(0, 0, 1.0), (0, 1, 3.0), (0, 2, 5.0), (1, 0, 2.0), (1, 1, 4.0), (1, 2, 6.0)]
