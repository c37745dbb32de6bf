"""Registered queries, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL twin."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def event_bars_sql(unit: str = "hour") -> str:
    return f"""bars AS (
  SELECT event_type AS symbol, date_trunc('{unit}', ts)::TIMESTAMP AS ts, first(value ORDER BY e.ts, event_id) AS open, max(value) AS high,
    min(value) AS low, last(value ORDER BY e.ts, event_id) AS close, count(*)::DOUBLE AS volume
  FROM events e WHERE value > 0 GROUP BY event_type, date_trunc('{unit}', e.ts)::TIMESTAMP
)"""


def ship_bars_sql(unit: str = "day", by_brand: bool = False) -> str:
    symbol = "p_brand" if by_brand else "l_returnflag || l_linestatus"
    source = "lineitem JOIN part ON l_partkey = p_partkey" if by_brand else "lineitem"
    return f"""bars AS (
  SELECT {symbol} AS symbol, date_trunc('{unit}', l_shipdate)::TIMESTAMP AS ts, first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close, sum(l_quantity) AS volume
  FROM {source} GROUP BY 1, 2
)"""


NUMBERED_SQL = "numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"
SESSIONS_SQL = """sessions AS (
  SELECT d::DATE AS label, d::TIMESTAMP + INTERVAL 870 MINUTE AS open_ts, d::TIMESTAMP + INTERVAL 1260 MINUTE AS close_ts
  FROM generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6
)"""


def sessions(spark: SparkSession) -> DataFrame:
    from barspark.operators.sessions import weekday_sessions

    return weekday_sessions(spark, "2024-01-01", "2024-12-31")
