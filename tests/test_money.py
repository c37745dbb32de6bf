"""Exact sizes, rebalance flows and bracket strategies against written-out rules."""

import datetime
import random
from decimal import ROUND_CEILING, ROUND_FLOOR, ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from barspark.operators import money
from barspark.plans import rebalance

E8 = Decimal("0.00000001")


def sized(cash, held, open_, weight, fixed, bps, slip, step, least):
    """Largest affordable quantity by bisection."""
    with localcontext() as c:
        c.prec = 200
        one = Decimal(1) if step == "whole" else E8
        target = weight * (cash + held * open_).quantize(E8, ROUND_HALF_UP)
        desired = (target / open_ / one).to_integral_value(ROUND_FLOOR) * one
        wanted = desired - held
        price = (open_ * (1 + slip if wanted > 0 else 1 - slip)).quantize(E8, ROUND_HALF_UP)
        fee = lambda q: (fixed + q * price * bps).quantize(E8, ROUND_CEILING)
        if wanted > 0:
            budget = cash if step == "whole" else min(cash, target - held * open_)
            low, high = 0, int(wanted / one)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if mid * one * price + fee(mid * one) <= budget else (low, mid - 1)
            filled = Decimal(0) if budget < least else low * one
        else:
            filled = -min(-wanted, held)
            if wanted < 0 and cash - filled * price - fee(-filled) < 0:
                filled = Decimal(0)
        paid = fee(abs(filled)) if filled else Decimal(0)
        return wanted, filled, price, paid, cash - filled * price - paid


@pytest.mark.parametrize("step", ["whole", "fraction"])
def test_sizes_to_the_last_place(spark, step):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        price = Decimal(rng.randint(1, 10**rng.choice([6, 9, 12]))) * E8
        price = max(price, Decimal("0.01")).quantize(E8)
        held = Decimal(rng.choice([0, 0, 3, 250])) if step == "whole" else Decimal(rng.randint(0, 10**10)) * E8
        rows.append((k, Decimal(rng.randint(0, 10**12)) * E8, held, price, Decimal(rng.choice([0, 1, 33333333, 50000000, 100000000])) * E8))
    rows = [r for r in rows if r[4] * (r[1] + r[2] * r[3]) / r[3] < 900_000]
    assert len(rows) > 250
    df = spark.createDataFrame(rows, "k int, cash decimal(22, 8), held decimal(14, 8), open decimal(14, 8), weight decimal(9, 8)")
    got = {r.k: r for r in money.order_sizes(df, 1.5, 7.5, 3.0, step, 20.0 if step == "fraction" else 0.0).collect()}
    for k, cash, held, price, weight in rows:
        want = sized(cash, held, price, weight, Decimal("1.5"), Decimal("0.00075"), Decimal("0.0003"), step, Decimal(20) if step == "fraction" else Decimal(0))
        r = got[k]
        assert (r.wanted, r.filled, r.price, r.fee, r.cash_after) == want, (k, rows[k])
        assert r.cash_after >= 0 and r.held_after == held + r.filled
        assert r.status == ("none" if not r.wanted else "rejected" if not r.filled else "filled" if r.filled == r.wanted else "reduced")


def test_what_does_not_fit_raises(spark):
    df = spark.createDataFrame([(Decimal(10), Decimal(0), Decimal("2e6"), Decimal(1))], "cash decimal(22, 8), held decimal(14, 8), open decimal(20, 8), weight decimal(9, 8)")
    with pytest.raises(Exception, match="OUT_OF_RANGE|cannot be represented|NUMERIC_VALUE"):
        money.order_sizes(df, 0, 0, 0).collect()
    with pytest.raises(ValueError):
        money.order_sizes(df, 0, 0, 0, "half")


def test_split_capital(spark):
    df = spark.createDataFrame([("a", k, 1.5) for k in range(7)] + [("b", 1, 0.25)], "strategy string, ticker int, growth double")
    got = {r.strategy: r for r in money.split_capital(df, 100).collect()}
    part = (Decimal(100) / 7).quantize(E8, ROUND_FLOOR)
    assert got["a"].invested == 7 * part * Decimal("1.5") and got["a"].idle == 100 - 7 * part and got["a"].accounts == 7
    assert got["b"].total == 25 and got["b"].idle == 0


def test_decisions(spark):
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    panel = spark.createDataFrame([(s, day(k), v if k != 4 or s != "c" else None) for k in range(8) for s, v in (("a", 3.0), ("b", 2.0), ("c", 1.0), ("late", 9.0)) if s != "late" or k > 2], "symbol string, ts timestamp, score double")
    held = spark.createDataFrame([(day(k), s, 0.3) for k in (0, 4) for s in ("b", "c")], "ts timestamp, symbol string, current double")
    due = rebalance.rebalances(panel, "every_n", 4)
    assert [tuple(r) for r in due.orderBy("ts").collect()] == [("rebalance-000001", day(0)), ("rebalance-000002", day(4))]
    found = rebalance.decisions(panel, due, {"name": "top_n_equal", "config": {"n": 2}}, held, lookback=3, reserve=0.1)
    got = {(r.rebalance_id[-1], r.symbol): (r.frozen, round(r.target, 9), r.reason) for r in found.collect()}
    # at first none has three observations: what is held is frozen; then c has no score, and the late one too few
    assert got[("1", "b")][0] and got[("1", "c")][0] and len([k for k in got if k[0] == "1"]) == 2
    assert got[("2", "c")] == (True, 0.3, "frozen: no score") and ("2", "late") not in got
    assert got[("2", "a")][1] == got[("2", "b")][1] == 0.3 and got[("2", "a")][2].startswith("selected; reduced for reserve and frozen")
    with pytest.raises(ValueError):
        rebalance.rebalances(panel, "yearly")
