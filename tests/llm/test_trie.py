"""The conversation trie against a plain one and its SQL, on planted and awkward conversations."""

import random

import duckdb
import pytest

from weirflow.llm import prefix_trie, queries

from . import brute

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def made(seed):
    """Conversations that share beginnings of many lengths, copies, long copies, ties and nulls."""
    rng, rows = random.Random(seed), []
    stock = [(rng.choice("ab"), "x" * rng.randint(0, 9)) for _ in range(4)]
    long = [("u", f"long {i}") for i in range(20)]
    for c in rng.sample(range(-250, 900), 180):
        kind = rng.random()
        turns = [rng.choice(stock) for _ in range(rng.randint(1, 5))] if kind < 0.7 else long[: rng.choice((10, 17, 20))] if kind < 0.85 else [stock[0]] * 7
        rows += [(c, None if rng.random() < 0.05 else t - 3, *(None if rng.random() < 0.05 else x for x in turn), "clash") for t, turn in enumerate(turns)]
    rows += [(None, 1, "a", "lost", ""), (7000, 0, "u", "é𝒳", ""), (7100, 5, "u", "same", ""), (7100, 5, "u", "same", ""), (7100, 5, "a", "same", ""), (7101, 300, "u", "late", ""), (7101, -300, "u", "early", "")]
    rng.shuffle(rows)
    return rows


def table(df):
    assert df.columns == prefix_trie.NODES.replace(" long", "").replace(" string", "").split(", ")
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = made(seed)
    got = table(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == sorted(brute.trie(r[:4] for r in rows))
    assert max(r[1] for r in got) >= 20 and any(r[3] > 2 and r[1] > 1 for r in got)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b", "")], [(5, None, None, None, "")], [(100, 1, "a", "b", "")] * 3, [(1, 1, "a", "b", ""), (2, 1, "a", "b", ""), (4, 1, "a", "b", "")]], ids=len)
def test_small_tries(spark, rows):
    got = table(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted(brute.trie(r[:4] for r in rows))


def test_digests_stream(spark):
    """Members of one class in several parts and batches give the digest of the whole list."""
    import hashlib

    ids = [*range(-9000, 9000, 2), 1 << 40]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        members = spark.createDataFrame([(c, -9000, len(ids)) for c in ids] + [(3, 3, 1)], "conv_id long, class long, w long")
        got = dict(prefix_trie.ends(members.repartition(7)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {-9000: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 3: hashlib.sha256(b"3").hexdigest()}


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = queries.QUERIES["op11_prefix_trie"](spark, sf)
    want = con.sql(queries.ORACLE_SQL["op11_prefix_trie"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
