"""Support history, vendor events, portfolios, registries and ranks against written-out rules."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.functions import indicators as ind
from barspark.operators import rollup, strategy, support, validate, vendor
from barspark.plans import strategies
from barspark.queries import QUERIES, catalog  # noqa: F401

START = datetime.datetime(2024, 1, 2, 14)
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def walk(n, seed=0, symbol="A"):
    close = 50 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n)))
    return [(symbol, START + datetime.timedelta(hours=i), float(c), float(c * 1.01), float(c * 0.99), float(c), 1.0 + i % 3) for i, c in enumerate(close)]


def test_support_changes_no_reported_value(spark):
    bars = spark.createDataFrame(walk(200), BARS)
    start = str(START + datetime.timedelta(hours=120))
    whole = ind.rsi(ind.numbered(bars)).where(F.col("ts") >= start).orderBy("ts").select("rsi").toPandas().rsi
    got = support.with_support(bars, start, ind.rsi).orderBy("ts").toPandas()
    assert got.source_index.tolist() == list(range(80)) and "is_support" not in got
    np.testing.assert_allclose(got.rsi, whole)
    few = support.with_support(bars, start, ind.rsi, lookback=5).orderBy("ts").toPandas().rsi
    assert few.isna().sum() == 9
    split = support.split_support(bars, start)
    assert support.as_of(split, index=3).count() == 124 and support.as_of(split, ts=start).count() == 121
    broken = bars.limit(199).union(bars.limit(1))
    assert sorted(r.fault for r in support.identity_breaks(bars, broken).collect()) == ["lost", "repeated"]
    with pytest.raises(ValueError):
        support.features(bars, {"Close": F.lit(1)})


def test_event_tables(spark):
    df = spark.createDataFrame([("A", 3, 5), ("A", 1, 0), ("B", None, 2), ("B", 2, None)], "symbol string, a int, b int")
    got = {(r.symbol, r.a): (r.ordinal, r.fault) for r in support.event_table(df, "a", "b").collect()}
    assert got == {("A", 1): (0, "end before start"), ("A", 3): (1, None), ("B", None): (0, "no start"), ("B", 2): (1, "no end")}


def test_conflicting_vendor_revisions(spark):
    day = datetime.datetime(2024, 1, 5)
    row = dict(symbol="A", security_id=1, event_unique_id=1, event_id=1, ts_record=day, event_action="I", event="FSPLT", event_subtype=None, payment_type=None, marker=None, outturn_security_id=None, ratio_old=1.0, ratio_new=2.0, gross_dividend=None, rate_currency=None, trading_currency="USD", ex_date=day.date(), effective_date=None, event_date=None)
    rows = [
        row, row | dict(ratio_new=3.0),  # the same time, other content
        row | dict(event_unique_id=2, event_id=2), row | dict(event_unique_id=2, event_id=2, ts_record=day + datetime.timedelta(1), ratio_new=4.0), row | dict(event_unique_id=2, event_id=2, ts_record=day + datetime.timedelta(60), ratio_new=9.0),
        row | dict(event_unique_id=3, event_id=3), row | dict(event_unique_id=4, event_id=3),
        row | dict(event_unique_id=5, event_id=5, event_action="C"), row | dict(event_unique_id=6, event_id=6, event=None), row | dict(event_unique_id=7, event_id=7, ex_date=datetime.date(2030, 1, 1)),
    ]
    schema = "symbol string, security_id long, event_unique_id long, event_id long, ts_record timestamp, event_action string, event string, event_subtype string, payment_type string, marker string, outturn_security_id long, ratio_old double, ratio_new double, gross_dividend double, rate_currency string, trading_currency string, ex_date date, effective_date date, event_date date"
    factors = spark.createDataFrame([], "event_id long, security_id long, exchange string, ex_date date, ts_created timestamp, factor double, reason int, dividend_currency string, option int, status string")
    records = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = {r.event_id: r for r in vendor.resolved_events(records, factors, "2024-01-01", "2024-12-31", "2024-02-01", "X").collect()}
    assert {k: (r.status, r.fault) for k, r in got.items()} == {1: ("pending", "conflicting revisions"), 2: ("apply", None), 3: ("pending", "several benefits"), 5: ("cancelled", None), 6: ("apply", None)}
    assert (got[2].share_ratio, got[2].price_factor, got[2].revisions) == (4.0, 0.25, 2) and got[6].event_type == "unknown"


def test_drifting_equity_against_a_loop(spark):
    rows = [r for k, s in enumerate("ABC") for i, r in enumerate(walk(60, k, s)) if s != "C" or i % 5]
    prices = spark.createDataFrame(rows, BARS)
    plan = {0: {"A": 0.5, "B": 0.3}, 20: {"B": 0.2, "C": 0.7}, 41: {"A": 1.0}}
    targets = spark.createDataFrame([(START + datetime.timedelta(hours=h), s, w) for h, x in plan.items() for s, w in x.items()], "ts timestamp, symbol string, weight double")
    close = {}
    for s, ts, *_, c, _ in rows:
        close[s, ts] = c
    last, equity, cash, held, want = {}, 1000.0, 1000.0, {}, {}
    for h in range(60):
        ts = START + datetime.timedelta(hours=h)
        last |= {s: close[s, ts] for s in "ABC" if (s, ts) in close}
        equity = cash + sum(n * last[s] for s, n in held.items())
        want[ts] = equity
        if h in plan:
            held = {s: w * equity / last[s] for s, w in plan[h].items()}
            cash = equity * (1 - sum(plan[h].values()))
    got = {r.ts: r.equity for r in strategy.drifting_equity(prices, targets, 1000.0).collect()}
    assert got.keys() == want.keys()
    for ts, x in want.items():
        assert abs(got[ts] - x) < 1e-6


def test_strategies_by_name():
    for spec in ({"name": "none"}, {"name": "momentum", "config": {"back": 3}}, {"name": "momentum", "other": 1}, {"name": "average_crossing", "config": {"fast": 9, "slow": 3}}, {"name": "weighted", "config": {"parts": [{"name": "momentum", "config": {"lookback": 3}}], "weights": [0.5]}}):
        with pytest.raises(ValueError):
            strategies.strategies.load(spec)
    with pytest.raises(ValueError):
        strategies.strategies.add("momentum")(lambda: None)


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_of_ties_and_nulls(spark, descending):
    rng = np.random.default_rng(4)
    rows = [(int(i), None if i % 13 == 0 else 7.0 if i % 3 == 0 else float(rng.integers(0, 400))) for i in range(2000)]
    df = spark.createDataFrame(rows, "ticker long, x double")
    got = {r.ticker: r.place for r in rollup.ranked(df, "x", "ticker", descending, parts=50).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, 0 if r[1] is None else -r[1] if descending else r[1], r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(order)}
    assert rollup.ranked(df.limit(0), "x", "ticker").count() == 0


def test_equal_sums_tie_in_any_order_of_their_rows(spark, tmp_path):
    prices = [0.1, 0.2, 0.3, 250000.07]
    orders = [(t, "F", "1-URGENT", x) for t in range(1, 9) for x in (prices if t % 2 == 0 else prices[::-1])]
    spark.createDataFrame(orders, "o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.ticker: r.place for r in QUERIES["g03_ranked_metrics"](spark, str(tmp_path)).collect()}
    assert got == {t: t for t in range(1, 9)}
    odd = spark.createDataFrame([(1, 1.0), (1, float("nan")), (2, float("inf")), (2, 1.0), (3, None), (4, 0.1), (4, None), (4, 0.2)], "k int, x double")
    found = dict(odd.groupBy("k").agg(rollup.exact_sum(F.col("x")).cast("string")).collect())
    assert found == {1: "NaN", 2: "Infinity", 3: None, 4: "0.3"}


def test_inferred_metrics(spark):
    counts = spark.createDataFrame([("a", "win", 3.0), ("a", "loss", 1.0), ("b", "win", 1.5), ("c", "win", 1.0), ("c", "win", 2.0), ("d", " ", 1.0), ("e", "win", -1.0), ("f", "win", None)], "ticker string, outcome string, n double")
    counts = rollup.with_roles(counts, outcome="category", n="count")
    one = spark.createDataFrame([("a", 5, 2.5, 9.0, True), ("b", 1, None, 9.0, True), ("c", 1, 1.0, 1.0, False), ("c", 2, 1.0, 1.0, False)], "ticker string, trades int, sharpe double, last_price double, flag boolean")
    one = rollup.with_roles(one, trades="count", last_price="price")
    series = one.withColumn("date", F.current_date())
    tables = {"outcomes": counts, "one": one, "detail": series, "said": series.select("ticker", "date", "sharpe"), "nothing": one.select("ticker", "flag")}
    got = {(r.ticker, r.table, r.metric, r.value, r.aggregation) for r in rollup.inferred_metrics(tables, summaries=("said",)).collect()}
    assert got == {
        ("a", "outcomes", "win", 3.0, "sum"), ("a", "outcomes", "loss", 1.0, "sum"), ("f", "outcomes", "win", None, "sum"),
        ("a", "one", "trades", 5.0, "sum"), ("a", "one", "sharpe", 2.5, "none"), ("b", "one", "trades", 1.0, "sum"), ("a", "said", "sharpe", 2.5, "none"),
    }
    assert rollup.inferred_metrics({"nothing": tables["nothing"]}).count() == 0
    assert rollup.roles(one.where("trades > 1").select("ticker", "trades"), "ticker") == {"trades": "count"}
    for bad in (dict(trades="total"), dict(other="count")):
        with pytest.raises(ValueError):
            rollup.with_roles(one, **bad)


def test_identifiers_and_timeframes(spark):
    df = spark.createDataFrame([("a b/c*~",), (" 90M ",), ("120m",), ("0d",), ("x",), (None,)], "x string")
    got = {r.x: (r.e, r.t and (r.t.amount, r.t.unit, r.t.seconds)) for r in df.select("x", validate.encoded(F.col("x")).alias("e"), validate.timeframe(F.col("x")).alias("t")).collect()}
    assert got["a b/c*~"][0] == "a%20b%2Fc%2A~"
    assert {k: v[1] for k, v in got.items()} == {"a b/c*~": None, " 90M ": (90, "m", 5400), "120m": (2, "h", 7200), "0d": None, "x": None, None: None}
