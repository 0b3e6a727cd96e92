"""Where query modules put their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: events as sampled series, for SQL.
SERIES = "WITH s AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM events)"


def query(sql: str | None = None):
    """Register the function under its name, with its SQL if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    """Rounded to what two engines agree on; adding 0 drops the sign of zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def r6_scaled(c: Column | str) -> Column:
    """As r6, but by way of the millionfold's nearest whole number, as SQL engines round doubles. F.round goes by the shortest
    decimal digits instead, which differs beside a 5 as seventh decimal and where the millionfold has no digits left for it."""
    x = F.col(c) if isinstance(c, str) else c
    scaled = F.round(x * F.lit(1e6)) / F.lit(1e6)
    return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(x) + F.lit(0.0)


def r6_up(c: Column | str) -> Column:
    """As r6 for values that may have a 5 as their seventh and last decimal: a shift far below that digit, and far above
    what two engines differ by, has them all rounded up."""
    return r6((F.col(c) if isinstance(c, str) else c) + F.lit(3e-10))
