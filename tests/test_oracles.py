"""Every query with an SQL twin, on the smallest tables."""

import datetime
import math
from decimal import Decimal

import duckdb
import pytest

from barspark.queries import catalog  # noqa: F401
from barspark.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    found = [[plain(r[i]) for i in order] for r in values]
    return sorted(found, key=lambda r: [f"{x:.3f}" if isinstance(x, float) else x for x in r])


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a))  # both sides are rounded to six places or fewer
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, got.collect()), rows(names, want.fetchall())
    assert len(a) == len(b)
    assert all(same(x, y) for r, q in zip(a, b) for x, y in zip(r, q))
