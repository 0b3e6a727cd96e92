"""Each dealt operator has one registered query, and the pipeline is there."""

import re

import __spark_entry__ as e


def test_queries():
    numbers = sorted(int(m[1]) for n in e.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in e.queries()


def test_mix_against_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, e.queries()["op6_mixing"](spark, sf).collect()))
    assert got == sorted(con.sql(e.oracle_sql()["op6_mixing"]).fetchall())
