"""Importance resampling against a plain version and its SQL."""

import random

import duckdb
import pytest

from weirflow.llm import importance, queries

from . import brute

SF = "/root/testdata/sf0.001"


def made():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(300)] + ["Größe", "日本", "x-ray", "İ", "A b"]
    docs = [(i, " ".join(rng.choices(vocab[: rng.choice((20, 305))], k=rng.choice((0, 3, 19, 20, 60))))) for i in range(150)]
    docs += [(None, "w1 " * 30), (None, None), (3, None), (7, ""), (8, "  \n"), (9, "w1 W2,w3;" * 9000), (10, "same text " * 12), (10, "same text " * 12), (-4, "é" * 50)]
    rng.shuffle(docs)
    return docs, [" ".join(rng.choices(vocab[:20], k=30)), None, ""]


@pytest.mark.parametrize(("n", "percent"), [(1, 10), (3, 50)])
def test_against_plain(spark, n, percent):
    docs, target = made()
    by = importance.Resample(n=n, percent=percent)
    got = importance.resample(spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, weight string, part int"), spark.createDataFrame([(t,) for t in target], "text string"), by)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute.importance(docs, target, n=n, percent=percent)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(r[4] is not None for r in want) > 5


def test_draws_towards_the_target(spark):
    docs, target = made()
    rows = brute.importance(docs, target)
    near = lambda drawn: [r[2] / r[1] for r in rows if r[1] and (r[4] is not None) == drawn]
    assert sum(near(True)) / len(near(True)) > sum(near(False)) / len(near(False))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string")
    assert [tuple(r) for r in importance.resample(one, none).collect()] == [tuple(r) for r in brute.importance([(1, "a " * 20)], [])]


def test_many_partitions(spark, monkeypatch):
    """Ranks run on across the partitions of the ordered table."""
    monkeypatch.setattr(importance, "PER_PART", 10)
    docs, target = made()
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute.importance(docs, target)))


def test_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES["op12_importance"](spark, SF)
    want = con.sql(queries.ORACLE_SQL["op12_importance"])
    assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
