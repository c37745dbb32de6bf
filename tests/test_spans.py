"""Intervals, guards, checked ingest and roles against written-out rules."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.operators import detect, guards, resample, research, spans
from barspark.queries import QUERIES, catalog  # noqa: F401
from barspark.sources import store

START = datetime.datetime(2024, 1, 2, 14)
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def walk(n, seed=0, symbol="A", start=START, hours=1):
    rng = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return [(symbol, start + datetime.timedelta(hours=hours * i), float(c * rng.uniform(0.98, 1.02)), float(c * 1.03), float(c * 0.97), float(c), 1.0 + i % 3) for i, c in enumerate(close)]


def some_periods(n, rng):
    ends = [sorted(rng.integers(1, n + 1, 2).tolist()) for _ in range(60)]
    return [*map(tuple, ends), (1, 1), (n, n), (1, n), (5, 5), (n + 3, n + 9)]


def test_moments_of_any_interval(spark):
    rng = np.random.default_rng(1)
    rows = walk(300, 1, "A") + [(*r[:2], *(x * 1e6 for x in r[2:6]), r[6]) for r in walk(40, 2, "B")]
    periods = [(s, a, b) for s, n in (("A", 300), ("B", 40)) for a, b in some_periods(n, rng)]
    df = spark.createDataFrame(rows, BARS).repartition(5)
    got = detect.flat_statistics(spark.createDataFrame(periods, "symbol string, start_rn long, end_rn long"), df, 1.01)
    kept = {(r.symbol, r.start_rn, r.end_rn): r for r in got.collect()}
    assert set(kept) == set(periods)
    by = {s: [r for r in rows if r[0] == s] for s in "AB"}
    pools = {"A": [], "B": []}
    for s, a, b in set(periods):
        own, r = by[s][a - 1 : b], kept[s, a, b]
        red, above = [x[5] < x[2] for x in own], [x[3] > x[2] * 1.01 for x in own]
        moves = [y[5] / x[5] - 1 for x, y in zip(own, own[1:])]
        pools[s] += moves
        assert (r.bars, r.red, r.above, r.red_above, r.red_below) == (len(own), sum(red), sum(above), sum(x and y for x, y in zip(red, above)), sum(x and not y for x, y in zip(red, above)))
        assert r.returns == len(moves)
        assert r.volatility is None if not moves else math.isclose(r.volatility, 100 * float(np.std(moves)), rel_tol=1e-9, abs_tol=1e-9)
    for r in detect.pooled_statistics(got).collect():
        assert r.returns == len(pools[r.symbol]) and math.isclose(r.volatility, 100 * float(np.std(pools[r.symbol])), rel_tol=1e-9)


def test_quiet_interval_after_a_wild_one(spark):
    closes = [1.0, 1e5, 1e-3, 1e5, 10.0, 10.001, 10.002, 10.001, 10.003]
    rows = [("A", START + datetime.timedelta(hours=k), c, c, c, c, 1.0) for k, c in enumerate(closes)]
    got = detect.flat_statistics(spark.createDataFrame([("A", 5, 9)], "symbol string, start_rn long, end_rn long"), spark.createDataFrame(rows, BARS)).first()
    assert math.isclose(got.volatility, 100 * float(np.std([b / a - 1 for a, b in zip(closes[4:], closes[5:])])), rel_tol=1e-3)


def test_intervals_are_answered_without_a_row_for_each_bar(spark):
    df = spark.createDataFrame(walk(50), BARS)
    periods = spark.createDataFrame([("A", 1, 50)], "symbol string, start_rn long, end_rn long")
    plan = detect.flat_statistics(periods, df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "sequence" not in plan


@pytest.mark.parametrize("longest", [1, 2, 7, 64, 200])
def test_extremes_of_any_interval(spark, longest):
    rng = np.random.default_rng(longest)
    value = rng.integers(0, 9, 200).astype(float)
    df = spark.createDataFrame([("A", k + 1, float(v)) for k, v in enumerate(value)], "symbol string, rn int, v double")
    asked = {(int(a), int(min(200, a + rng.integers(0, longest)))) for a in rng.integers(1, 201, 80)} | {(1, min(longest, 200)), (200, 200)}
    found = spans.interval_extremes(df, spark.createDataFrame([("A", a, b) for a, b in asked], "symbol string, start_rn long, end_rn long"), F.col("v"), longest)
    got = {(r.start_rn, r.end_rn): (r["first"], r["last"], r.top, r.top_rn, r.low, r.low_rn) for r in found.collect()}
    assert got == {(a, b): (value[a - 1], value[b - 1], value[a - 1 : b].max(), a + value[a - 1 : b].argmax(), value[a - 1 : b].min(), a + value[a - 1 : b].argmin()) for a, b in asked}


def test_trend_records(spark):
    rows = walk(120, 4)
    bars = spark.createDataFrame(rows, BARS)
    evidence = detect.trend_evidence(bars, (8, 16)).cache()
    got = detect.trend_records(evidence, bars, young_bars=4, shock=0.5).collect()
    assert len(got) == evidence.count()
    x = np.log([r[5] for r in rows])
    for r, e in [(r, {(e.rn, e.lookback): e for e in evidence.collect()}[r.end_rn, r.duration]) for r in got]:
        own = e.direction * x[r.start_rn - 1 : r.end_rn]
        top = int(own.argmax())
        movement, retreat, young = max(0.0, own[top] - own[0]), max(0.0, own[top] - own[-1]), len(own) - 1 - top
        assert np.allclose([r.movement, r.retreat, r.retracement, r.young], [movement, retreat, retreat / max(movement, 1e-12), young])
        shock = retreat / (e.sigma * math.sqrt(max(1, young)))
        assert math.isclose(r.shock, shock, rel_tol=1e-9, abs_tol=1e-12) and r.abrupt == (0 < young < 4 and shock >= 0.5)
        assert r.start_ts == rows[r.start_rn - 1][1] and r.end_ts == rows[r.end_rn - 1][1]


def test_no_detector_spans_an_omission(spark):
    rows = walk(90, 5)
    lost = [rows[30][1], rows[61][1]]
    bars = spark.createDataFrame([r for r in rows if r[1] not in lost], BARS)
    omitted = spark.createDataFrame([("A", t) for t in lost] + [("A", rows[10][1]), ("A", START - datetime.timedelta(hours=5))], "symbol string, ts timestamp")
    cut = research.omission_segments(bars, omitted)
    runs = [[r for r in rows if r[1] < lost[0]], [r for r in rows if lost[0] < r[1] < lost[1]], [r for r in rows if r[1] > lost[1]]]
    keys = ("symbol", "segment")
    for find in (lambda b, **k: detect.flat_windows(b, 3, 9, limit=9.0, **k).select(F.unix_seconds("end_ts").alias("t"), "bars"), lambda b, **k: detect.trend_evidence(b, (8,), **k).select(F.unix_seconds("ts").alias("t"), F.round("evidence", 9), F.round("boundary", 9))):
        got = sorted(map(tuple, find(cut, keys=keys).collect()))
        assert got == sorted(tuple(r) for part in runs for r in find(spark.createDataFrame(part, BARS)).collect()) and got
    with pytest.raises(Exception, match="unresolved omissions in the source of A"):
        research.omission_segments(bars, omitted, unresolved=omitted).collect()


def sessions_of(spark, days):
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    return spark.createDataFrame([(datetime.date(2024, 1, d), at(d, 14), at(d, 18)) for d in days], "label date, open_ts timestamp, close_ts timestamp")


@pytest.fixture()
def stored(spark, tmp_path):
    """Hourly bars of two sessions of four hours each, as a file."""
    def write(rows):
        path = str(tmp_path / f"bars{len(rows)}")
        spark.createDataFrame(rows, BARS).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return write


def test_rules_stop_the_job_in_one_scan(spark, stored):
    day = lambda d, n, h=14, m=0: walk(n, d, start=datetime.datetime(2024, 1, d, h, m))
    whole = day(2, 4) + day(3, 4)
    known = sessions_of(spark, (2, 3))
    found = resample.resample_hourly_to_daily(stored(whole), known)
    assert guards.scans(found) == 1 and sorted((r.observed, r.expected) for r in found.collect()) == [(4, 4), (4, 4)]
    with pytest.raises(Exception, match="bar outside all sessions: A 2024-01-03 18"):
        resample.resample_hourly_to_daily(stored(day(2, 4) + day(3, 5)), known).collect()
    with pytest.raises(Exception, match="off the grid"):
        resample.resample_hourly_to_daily(stored(day(2, 4) + day(3, 3, 14, 30)), known).collect()
    for short in (day(2, 4) + day(3, 3), day(2, 4)):  # an interval that lacks a bar, and a whole one
        with pytest.raises(Exception, match="intervals lack source bars: A"):
            resample.resample_hourly_to_daily(stored(short), known).collect()
    assert resample.resample_hourly_to_daily(stored(day(2, 4) + day(3, 3)), known, "drop").count() == 1
    assert resample.resample_sessions(stored(day(2, 4) + day(3, 5)), known, None, 60).count() == 2


def test_sessions_must_be_those_of_the_calendar(spark, stored):
    bars = stored(walk(4, 1))
    known = sessions_of(spark, (2, 3))
    found = resample.resample_regular_hours(bars, sessions_of(spark, (2,)), known, "aggregate", 60)
    assert guards.scans(found) == 1 and found.count() == 4
    for wrong in (sessions_of(spark, (2, 4)), known.withColumn("close_ts", F.col("close_ts") - F.expr("INTERVAL 1 HOUR")), known.union(known)):
        with pytest.raises(Exception, match="differ from the calendar"):
            resample.resample_regular_hours(bars, wrong, known, "aggregate", 60).collect()


def test_a_second_row_of_a_ticker_stops_the_screening(spark):
    asked = spark.createDataFrame([("a", 1), ("b", 0)], "ticker string, place int")
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "ticker string, value double")
    assert [tuple(r) for r in research.screening(rows, asked).orderBy("place").collect()] == [(0, "b", 2.0), (1, "a", 1.0)]
    with pytest.raises(Exception, match="more than one row of a"):
        research.screening(rows.union(rows.where("ticker = 'a'")), asked).collect()


def test_screening_counts_the_rows_of_each_ticker(spark, sf):
    got = {r.ticker: r.rows_found for r in QUERIES["g08_screening"](spark, sf).collect()}
    orders = spark.read.parquet(f"{sf}/orders.parquet").join(spark.read.parquet(f"{sf}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    assert got == dict(orders.groupBy("c_custkey").count().collect()) and sum(got.values()) == orders.count()


def test_ingest_refuses_what_was_not_asked_for(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = walk(10)
    df = spark.createDataFrame(rows, BARS)
    ask = dict(symbols=["A"], start="2024-01-02", end="2024-01-03 01:00:00")
    bad = rows[:3] + [(*rows[3][:3], float("nan"), *rows[3][4:])]
    faults = {
        "other_symbol": (df, dict(symbols=["B"])), "out_of_bounds": (df, dict(end="2024-01-02 16:00:00")), "invalid": (spark.createDataFrame(bad, BARS), {}), "repeated keys": (df.union(df.limit(1)), {}),
    }
    for k, (what, (batch, other)) in enumerate(faults.items()):
        with pytest.raises(store.RequestError, match=what):
            store.ingest(batch, path, "x", "1h", f"bad{k}", **(ask | other))
    with pytest.raises(store.RequestError, match="not_midnight"):
        store.ingest(df, path, "x", "1d", "days", **ask)
    assert store.revisions(spark, path).count() == 0
    store.ingest(df, path, "x", "1h", "good", **ask)
    assert store.scan(spark, path, "raw", "1h", "2024-01-01", "2024-02-01").count() == 10
    assert [tuple(r) for r in store.audit(spark, path).collect()] == [("good", 10, 0, 0, True)]


def test_a_batch_is_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    store.ingest(spark.createDataFrame(walk(25), BARS).mapInArrow(counted, BARS), str(tmp_path / "store"), "x", "1h", "r", ["A"], "2024-01-01", "2024-02-01")
    assert seen.value == 25


def test_audit_finds_what_changed_since(spark, tmp_path):
    path = str(tmp_path / "store")
    for k, name in enumerate(("kept", "lost", "spoilt", "doubled")):
        store.write_batch(spark.createDataFrame(walk(6, k, start=START + datetime.timedelta(days=k)), BARS), path, "raw", "x", "1h", name)
    whole = spark.read.parquet(path)
    changed = whole.where("revision <> 'lost' or hour(ts) > 15").withColumn("high", F.when((F.col("revision") == "spoilt") & (F.hour("ts") == 15), 0.0).otherwise(F.col("high")))
    changed = changed.union(changed.where("revision = 'doubled' and hour(ts) = 15"))
    again = str(tmp_path / "again")
    changed.write.partitionBy("layer", "provider", "timeframe", "revision", "year").parquet(again)
    spark.read.parquet(f"{path}.revisions").write.parquet(f"{again}.revisions")
    assert sorted(tuple(r) for r in store.audit(spark, again).collect()) == [("doubled", 7, 0, 1, False), ("kept", 6, 0, 0, True), ("lost", 4, 0, 0, False), ("spoilt", 6, 1, 0, False)]


def test_identity_faults(spark):
    from barspark.operators import actions

    day = lambda k: datetime.date(2024, 1, k)
    spans_ = spark.createDataFrame([(s, n, day(5), day(20)) for n, s in enumerate("abcdef")] + [("n", None, day(5), day(20))], "symbol string, security_id int, first_date date, last_date date")
    coverage = spark.createDataFrame([("a", 0, day(1), day(30)), ("b", 9, day(1), day(30)), ("c", 9, day(21), day(30)), ("n", None, day(1), day(30))], "symbol string, security_id int, start_date date, end_date date")
    rows = [("a", 0, day(7), "split", "2:1", "resolved"), ("b", 1, day(7), "split", "2:1", "unresolved"), ("d", 3, day(8), "split", "2:1", "resolved"), ("d", 3, day(8), "split", "2:1", "resolved"), ("e", 4, day(25), "split", "2:1", "unresolved"), ("f", 9, day(9), "split", "2:1", None)]
    events = spark.createDataFrame(rows, "symbol string, security_id int, effective_date date, event_type string, terms string, status string")
    got = {r.symbol: r.faults for r in actions.identity_faults(spans_, coverage, events).collect()}
    assert got == {"a": [], "b": ["other security", "unresolved event"], "c": [], "d": ["duplicate terms"], "e": [], "f": ["other security"], "n": []}
