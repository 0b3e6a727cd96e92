"""Every library query runs; those with SQL agree with DuckDB row by row."""

import math

import duckdb
import pytest

from weirflow.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return "nan" if math.isnan(v) else round(float(v), 5) + 0.0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert rows
    if name in ORACLE_SQL:
        got = duck.sql(ORACLE_SQL[name])
        at = [got.columns.index(c) for c in columns]
        assert sorted(got.columns) == columns
        assert rows == sorted(str(tuple(plain(r[k]) for k in at)) for r in got.fetchall())


def test_sql_belongs_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_normalised_values_are_rounded_as_in_sql(spark, duck, tmp_path):
    """Beside a 5 as seventh decimal, over a tiny divisor, over zero and of nulls: equal to SQL's to the last bit."""
    groups = [(1, [2.1e-06, 258.3714451]), (2, [0.0, 0.0, 2.5]), (3, [None, 4.0]), (4, [-3.0, 1e300, None])]
    rows = [(10 * u + i, u, v) for u, values in groups for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    duck = duck.cursor()
    duck.execute(f"CREATE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("absunitscale_minor_by_user", "absunitscale_by_user", "unitscale_by_user"):
        want = {r[0]: repr(r[1]) for r in duck.execute(ORACLE_SQL[name]).fetchall()}
        assert {r.event_id: repr(r.y) for r in QUERIES[name](spark, str(tmp_path)).collect()} == want
