"""Queries whose parameters once left out most of the work: they go on until a group is decided, or to the last overtone."""

import math

import duckdb
import numpy as np
import pandas as pd

from weirflow.queries import ORACLE_SQL, QUERIES


def test_adaptive_shuffle_goes_on_beyond_128(spark, tmp_path):
    rng = np.random.default_rng(5)
    a, x = np.arange(300) % 3 == 0, rng.normal(size=300)
    x -= np.where(a, x[a].mean(), x[~a].mean())
    x += a * 1.96 * x.std() * math.sqrt(1 / a.sum() + 1 / (~a).sum())
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(300), unit="s")
    pd.DataFrame({"event_id": np.arange(300), "ts": ts.astype("datetime64[us]"), "user_id": np.arange(300), "event_type": "view", "value": x}).to_parquet(tmp_path / "events.parquet")
    got = QUERIES["adaptive_shuffle"](spark, str(tmp_path)).first()
    assert got.n > 128 and (got.decided or got.n == 2048)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert duck.execute(ORACLE_SQL["adaptive_shuffle"]).fetchall() == [tuple(got)]


def test_shuffled_importance_goes_on_until_decided(spark, tmp_path):
    """A set that no shuffle comes near is decided by 128 of them, and not before."""
    rng = np.random.default_rng(6)
    n = 400
    quantity = rng.uniform(1, 50, n)
    items = {"l_orderkey": np.arange(n) // 4, "l_linenumber": np.arange(n) % 4, "l_quantity": quantity, "l_discount": rng.uniform(0, 0.1, n), "l_tax": rng.uniform(0, 0.08, n), "l_extendedprice": 1000 * quantity + rng.normal(size=n)}
    pd.DataFrame(items).to_parquet(tmp_path / "lineitem.parquet")
    got = {r.features: r for r in QUERIES["shuffled_importance"](spark, str(tmp_path)).collect()}
    assert got["size"].decided and (got["size"].n, got["size"].k) == (128, 0)
    assert got["rates"].decided or got["rates"].n == 2048


def test_line_noise_goes_with_five_overtones(spark, tmp_path):
    n = 1500
    t = np.arange(n) / 1000
    slow = np.sin(2 * np.pi * 7 * t)
    x = slow + sum(np.sin(2 * np.pi * 60 * k * t + k) for k in range(1, 6))
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s")
    pd.DataFrame({"event_id": np.arange(n), "ts": at.astype("datetime64[us]"), "user_id": 1, "event_type": "view", "value": x}).to_parquet(tmp_path / "events.parquet")
    got = np.array([r.stopped for r in QUERIES["line_noise_removed"](spark, str(tmp_path)).orderBy("i").collect()])
    assert np.abs(got - slow)[300:-300].max() < 0.1
