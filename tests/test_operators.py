"""Small fixtures with results worked out by hand."""

import datetime
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.operators import actions, detect, intervals, resample, rollup, strategy, validate
from barspark.operators import sessions as cal
from barspark.plans.pipeline import Contract, registry
from barspark.queries import ORACLES, QUERIES, catalog  # noqa: F401
from barspark.schema import utc
from barspark.sources import payloads, store
from barspark.streaming.bars import stream_bars

BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
dt = datetime.datetime


def minutes(spark, start, n, symbol="A", skip=()):
    rows = [(symbol, start + datetime.timedelta(minutes=i), 100.0 + i, 102.0 + i, 99.0 + i, 101.0 + i, 10.0) for i in range(n) if i not in skip]
    return spark.createDataFrame(rows, BARS)


def session(spark, open_ts, close_ts):
    return utc(spark).createDataFrame([(open_ts.date(), open_ts, close_ts)], "label date, open_ts timestamp, close_ts timestamp")


def test_last_interval_of_a_session_is_short(spark):
    open_ts = dt(2024, 1, 2, 14, 30)
    s = session(spark, open_ts, open_ts + datetime.timedelta(minutes=75))
    got = resample.resample_sessions(minutes(spark, open_ts, 75), s, 30, 1).orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume, r.expected) for r in got] == [(100, 131, 99, 130, 300, 30), (130, 161, 129, 160, 300, 30), (160, 176, 159, 175, 150, 15)]


def test_incomplete_policies(spark):
    open_ts = dt(2024, 1, 2, 14, 30)
    s, bars = session(spark, open_ts, open_ts + datetime.timedelta(minutes=60)), minutes(spark, open_ts, 60, skip=(31,))
    assert resample.resample_sessions(bars, s, 30, 1, "drop").count() == 1
    assert sorted(r.observed for r in resample.resample_sessions(bars, s, 30, 1, "aggregate").collect()) == [29, 30]
    with pytest.raises(Exception, match="intervals lack source bars"):
        resample.resample_sessions(bars, s, 30, 1, "raise").collect()
    report = resample.quality_report(bars, s, 30, 1).collect()
    assert [(r.observed, r.missing) for r in report] == [(29, 1)]


def test_clock_change_sessions(spark):
    days = utc(spark).createDataFrame([(datetime.date(2024, 3, 8),), (datetime.date(2024, 3, 11),)], "label date")
    got = [r.open_ts.hour for r in cal.local_sessions(days, "America/New_York", "09:30:00", "16:00:00").orderBy("label").collect()]
    assert got == [14, 13]
    gap = spark.createDataFrame([(datetime.date(2024, 3, 10),), (datetime.date(2024, 11, 3),)], "label date")
    assert [r.valid for r in cal.local_sessions(gap, "America/New_York", "02:30:00", "16:00:00").orderBy("label").collect()] == [False, True]
    assert [r.valid for r in cal.local_sessions(gap, "America/New_York", "01:30:00", "16:00:00").orderBy("label").collect()] == [True, False]


def test_adjustment_leaves_the_bar_on_the_boundary(spark):
    at = dt(2024, 1, 3, 5)
    bars = utc(spark).createDataFrame([("A", at + datetime.timedelta(hours=h), 100.0, 110.0, 90.0, 105.0, 20.0) for h in (-1, 0, 1)], BARS)
    events = spark.createDataFrame([(1, "A", "split", at, 2.0, None, None, None, "USD", "confirmed"), (2, "A", "cash_dividend", at + datetime.timedelta(hours=1), None, None, 5.0, 100.0, "USD", "confirmed")],
        "event_id long, symbol string, event_type string, effective_ts timestamp, share_ratio double, price_factor double, cash_amount double, reference_close double, currency string, status string")
    good = actions.event_factors(events)
    assert {r.event_id: r.fault for r in good.collect()} == {1: None, 2: "needs an explicit factor"}
    alone = actions.event_factors(events.where("event_id = 1")).union(actions.event_factors(events.where("event_id = 2")))
    got = actions.adjust(bars, alone).orderBy("ts").collect()
    assert [(round(r.close, 6), r.volume) for r in got] == [(105 * 0.5 * 0.95, 40.0), (round(105 * 0.95, 6), 20.0), (105.0, 20.0)]


def test_times_are_rounded_to_milliseconds_for_the_grid(spark, tmp_path):
    times = ["2024-01-01 00:00:59.999600", "2024-01-01 00:00:59.999500", "2024-01-01 00:00:59.999499", "2024-01-01 00:01:00.000499", "2024-01-01 00:01:00.000500", "2024-01-01 00:01:00", "2024-01-01 00:01:30"]
    times += ["1969-12-31 23:59:59.999500", "1969-12-31 23:59:59.999501", "1969-12-31 23:58:59.999500", "1969-12-31 23:58:59.999501", None]
    rows = utc(spark).createDataFrame(list(enumerate(times)), "event_id long, at string").select("event_id", F.to_timestamp("at").alias("ts"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(r.event_id for r in QUERIES["b14_off_grid"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT event_id, ts::TIMESTAMP AS ts FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(r[0] for r in duck.execute(ORACLES["b14_off_grid"]).fetchall()) == [2, 4, 6, 7, 9]


def test_logarithms_hold_where_factors_leave_a_double(spark):
    first = dt(2000, 1, 3)
    bars = utc(spark).createDataFrame([("A", first + datetime.timedelta(days=d), 100.0, 110.0, 90.0, 105.0, 20.0) for d in (0, 1000, 3000)], BARS)
    events = spark.range(1, 3001).selectExpr("'A' symbol", "timestamp '2000-01-03' + make_interval(0, 0, 0, int(id)) effective_ts", "1 / 3d price", "3d volume")
    got = actions.adjust(bars, events, logs=True).orderBy("ts").collect()
    assert [(r.symbol, round(r.close, 6), round(r.volume, 6)) for r in got] == [("A", round(np.log(105) - n * np.log(3), 6), round(np.log(20) + n * np.log(3), 6)) for n in (3000, 2000, 0)]
    assert actions.adjust(bars, events.limit(0), logs=True).where("close <> ln(105d) or close is null").count() == 0


def test_caps_against_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(40):
        w = rng.random(6) ** 3
        rows += [(k, f"s{i}", float(x / w.sum())) for i, x in enumerate(w)]
    got = {(r.ts, r.symbol): r.capped for r in strategy.capped(spark.createDataFrame(rows, "ts long, symbol string, w double"), "w", 0.3, 1.0).collect()}
    for k in range(40):
        w = {s: x for t, s, x in rows if t == k}
        done, left = {}, dict(w)
        while True:
            room, total = 1.0 - 0.3 * len(done), sum(left.values())
            over = [s for s, x in left.items() if x * room / total >= 0.3]
            if not over:
                break
            for s in over:
                done[s] = left.pop(s)
        want = {s: 0.3 for s in done} | {s: x * (1.0 - 0.3 * len(done)) / sum(left.values()) for s, x in left.items()}
        assert all(abs(got[k, s] - want[s]) < 1e-12 for s in w)


def test_bracket_bounds_are_strict(spark):
    t = dt(2024, 1, 2)
    highs, lows = [100, 110, 111, 120, 100], [100, 100, 95, 80, 100]
    rows = [("A", t + datetime.timedelta(hours=i), 100.0, float(h), float(low), 100.0, 1.0) for i, (h, low) in enumerate(zip(highs, lows))]
    from barspark.functions.indicators import numbered

    bars = numbered(spark.createDataFrame(rows, BARS))
    got = {r.rn: (r.hit, r.outcome) for r in strategy.bracket_outcomes(bars, F.lit(True), 1.1, 0.9).collect()}
    assert got == {1: (3, "win"), 2: (3, "win"), 3: (4, "inconclusive"), 4: (None, "open")}


def test_first_beyond_against_a_loop(spark):
    from barspark.functions.indicators import numbered

    rng = np.random.default_rng(5)
    t, rows = dt(2024, 1, 2), []
    for k, s in enumerate("AB"):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, 900)))
        rows += [(s, t + datetime.timedelta(hours=i), float(c), float(c * 1.004), float(c * 0.996), float(c), 1.0) for i, c in enumerate(close)]
    bars = numbered(spark.createDataFrame(rows, BARS)).cache()
    own = {s: [r for r in rows if r[0] == s] for s in "AB"}
    for win, stop in ((1.02, 0.98), (1.3, 0.8), (50.0, 0.01)):
        side = F.when(F.col("rn") % 2 == 0, "short").otherwise("long")
        got = {(r.symbol, r.rn): (r.hit, r.outcome) for r in strategy.bracket_outcomes(bars, F.lit(True), win, stop, side).collect()}
        assert len(got) == 2 * 899
        for (s, n), (hit, outcome) in got.items():
            entry = own[s][n][2]
            high, low = (entry / stop, entry / win) if n % 2 == 0 else (entry * win, entry * stop)
            want = next((i + 1 for i in range(n, 900) if own[s][i][3] > high or own[s][i][4] < low), None)
            assert hit == want
            if want:
                up, down = own[s][want - 1][3] > high, own[s][want - 1][4] < low
                assert outcome == ("inconclusive" if up and down else "win" if up == (n % 2 == 1) else "loss")
            else:
                assert outcome == "open"
    small = strategy.first_beyond(bars, bars.select("symbol", "rn", (F.col("close") * 1.1).alias("upper"), (F.col("close") * 0.9).alias("lower")), width=4).collect()
    for r in small:
        assert r.hit == next((i + 1 for i in range(r.rn, 900) if own[r.symbol][i][3] > r.upper or own[r.symbol][i][4] < r.lower), None)


def loop_targets(rows, reserve, cap, turnover, least):
    """The rebalance rules written out for one time: (symbol, score, current, proposed) to targets."""
    known = {r[0]: r for r in rows}
    current = {s: r[2] or 0.0 for s, r in known.items()}
    frozen = {s for s, r in known.items() if r[1] is None and current[s] > 0}
    room = max(0.0, 1 - reserve - sum(current[s] for s in frozen))
    wish = {s: (r[3] or 0.0) if r[1] is not None else 0.0 for s, r in known.items() if s not in frozen}
    usable, left, capped = min(room, sum(wish.values())), dict(wish), {}
    while True:
        total = sum(left.values())
        share = {s: x / total * (usable - cap * len(capped)) if total else 0.0 for s, x in left.items()}
        over = [s for s, x in share.items() if x > cap + 1e-15]
        if not over:
            break
        for s in over:
            capped[s] = cap
            del left[s]
    desired = share | capped | {s: current[s] for s in frozen}
    base = {s: current[s] if s in frozen else min(current[s], cap) for s in known}
    held = sum(x for s, x in base.items() if s not in frozen)
    if held > room:
        base = {s: x if s in frozen else x * room / held for s, x in base.items()}
    must = sum(abs(base[s] - current[s]) for s in known)
    for s in known:
        if s not in frozen and desired[s] > 0 and abs(desired[s] - base[s]) < least:
            desired[s] = base[s]
    sold, bought = (sum(max(0, sign * (base[s] - desired[s])) for s in known) for sign in (1, -1))
    free = max(0.0, 1 - reserve - sum(base.values())) + sold
    if bought > free + 1e-12:
        desired = {s: base[s] + (x - base[s]) * free / bought if x > base[s] else x for s, x in desired.items()}
    moves, rest = sum(abs(desired[s] - base[s]) for s in known), max(0.0, turnover - must)
    if moves > rest + 1e-12:
        desired = {s: base[s] + rest / moves * (x - base[s]) for s, x in desired.items()}
    return desired


def test_rebalance_targets_against_a_loop(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(120):
        n = int(rng.integers(1, 9))
        held = rng.dirichlet(np.ones(n + 1))[:n] * rng.choice([0.0, 0.5, 1.0])
        asked = rng.dirichlet(np.ones(n)) * rng.choice([0.5, 1.0])
        for i in range(n):
            rows.append((k, f"s{i}", None if rng.random() < 0.25 else float(rng.random()), float(held[i]) if rng.random() < 0.8 else None, float(asked[i]) if rng.random() < 0.7 else None))
    df = spark.createDataFrame(rows, "ts long, symbol string, score double, current double, proposed double")
    for reserve, cap, turnover, least in ((0.0, 1.0, 2.0, 0.0), (0.1, 0.3, 0.4, 0.02), (0.5, 0.2, 0.1, 0.0)):
        got = {(r.ts, r.symbol): r for r in strategy.rebalance_targets(df, reserve, cap, turnover, least).collect()}
        assert len(got) == len(rows)
        for k in range(120):
            for s, x in loop_targets([r[1:] for r in rows if r[0] == k], reserve, cap, turnover, least).items():
                assert abs(got[k, s].target - x) < 1e-9, (k, s, got[k, s], x)
                assert got[k, s].reason


def test_flat_ranges_then_a_spike(spark):
    t = dt(2024, 1, 2)
    rows = [("A", t + datetime.timedelta(minutes=30 * i), c, c + 0.5, c - 0.5, c, 1.0) for i, c in enumerate([100.0] * 5 + [150.0] + [200.0] * 3)]
    bars = spark.createDataFrame(rows, BARS)
    for scale in (1.0, 1e12):
        scaled = bars.select("symbol", "ts", *[(F.col(c) * scale).alias(c) for c in ("open", "high", "low", "close")], "volume")
        windows = detect.flat_windows(scaled, 3, 8, limit=2.0)
        got = sorted((r.start_rn, r.end_rn) for r in windows.collect())
        assert got == [(1, 3), (1, 4), (1, 5), (7, 9)]
        assert sorted((r.start_rn, r.end_rn) for r in detect.disjoint_latest(windows).collect()) == [(1, 5), (7, 9)]
        assert [r.end_rn for r in detect.current_flat(windows, scaled).collect()] == [9]


def test_straight_trend(spark):
    t = dt(2024, 1, 2)
    rows = [("A", t + datetime.timedelta(hours=i), 1.0, 1.0, 1.0, float(np.exp(0.01 * i)), 1.0) for i in range(12)]
    got = detect.trend_gates(detect.trend_evidence(spark.createDataFrame(rows, BARS), (8,))).collect()
    assert len(got) == 5
    assert all(abs(r.slope - 0.01) < 1e-9 and r.ordering == 1 and abs(r.efficiency - 1) < 1e-9 and r.direction == 1 and r.accepted for r in got)


def test_missing_is_not_zero(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", 4.0, 2.0), ("c", 2.0, None), ("d", None, None)], "ticker string, x double, y double")
    got = {r.metric: (r.total, r.contributors) for r in rollup.across_tickers(df, "x", "y").collect()}
    assert got == {"x": (6.0, 2), "y": (3.0, 2)}
    r = rollup.ratio_of_sums(df, "x", "y", 10.0).first()
    assert (r.ratio, r.contributors) == (20.0, 1)
    assert [r.ticker for r in rollup.ranked(df, "x", "ticker").orderBy("place").collect()] == ["b", "c", "a", "d"]
    assert rollup.ratio_of_sums(df.withColumn("y", F.lit(0.0)), "x", "y").first().ratio is None


def test_touching_spans(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, 9)], "key string, start long, end long")
    assert sorted((r.start, r.end) for r in intervals.merged(df, "key").collect()) == [(1, 5), (7, 9)]
    assert sorted((r.start, r.end) for r in intervals.merged(df, "key", touching=False).collect()) == [(1, 3), (3, 5), (7, 9)]
    asked = spark.createDataFrame([("a", 0, 10), ("b", 0, 4)], "key string, start long, end long")
    assert sorted((r.key, r.start, r.end) for r in intervals.gaps(asked, df, "key").collect()) == [("a", 0, 1), ("a", 5, 7), ("a", 9, 10), ("b", 0, 4)]


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    first, second = minutes(spark, dt(2024, 1, 2, 14), 10), minutes(spark, dt(2024, 1, 3, 14), 10)
    store.write_batch(first, path, "raw", "x", "1m", "r1")
    store.write_batch(second, path, "raw", "x", "1m", "r2")
    with pytest.raises(store.OverlapError):
        store.write_batch(minutes(spark, dt(2024, 1, 2, 14, 5), 3), path, "raw", "x", "1m", "r3")
    with pytest.raises(ValueError):
        store.write_batch(first.union(first), path, "raw", "x", "1m", "r4")
    got = store.scan(spark, path, "raw", "1m", "2024-01-02 14:05:00", "2024-01-03 14:02:00")
    assert got.count() == 7
    with pytest.raises(ValueError):
        store.write_batch(minutes(spark, dt(2025, 1, 2, 14, 5), 3), path, "raw", "x", "1m", "r2")
    store.write_processed(first, path, ["r1"], "p", "q1")
    with pytest.raises(ValueError):
        store.write_processed(first, path, ["r1"], "p", "q2")
    with pytest.raises(ValueError):
        store.refresh(first.limit(3), path, ["r1"], "r6")
    with pytest.raises(ValueError):
        store.replace(first.where("ts > '2024-01-02 14:03:00'"), path, "r1", "r7")
    with pytest.raises(store.OverlapError):
        store.merge(spark, path, ["r1"], [("2024-01-02", "2024-01-03", minutes(spark, dt(2024, 1, 2, 14, 50), 2))], "r8")
    store.compact(spark, path, ["r1", "r2"], "r5")
    assert store.scan(spark, path, "raw", "1m", "2024-01-01", "2024-12-31").count() == 20
    assert store.scan(spark, path, "raw", "1m", "2024-01-01", "2024-12-31", history=True).count() == 40
    assert {r.revision for r in store.revisions(spark, path).where("active").collect()} == {"r5"}
    with pytest.raises(ValueError):
        store.compact(spark, path, ["r1", "r5"], "r9")
    assert store.scan(spark, path, "processed", "1m", "2024-01-01", "2024-12-31").count() == 0


def test_payload_faults(spark):
    good = {"timestamp": [60, 120], **{c: [1.0, 2.0] for c in ("open", "high", "low", "close", "volume")}}
    rows = [("A", json.dumps(good)), ("B", json.dumps(good | {"open": [1.0]})), ("C", json.dumps(good | {"timestamp": [60, 60]})), ("D", "nonsense")]
    bars, faults = payloads.columnar_bars(utc(spark).createDataFrame(rows, "symbol string, body string"))
    assert [(r.symbol, r.open) for r in bars.orderBy("ts").collect()] == [("A", 1.0), ("A", 2.0)]
    assert {r.symbol: r.fault for r in faults.collect()} == {"B": "lengths differ", "C": "repeated time", "D": "unreadable"}


def test_order_sizes_never_spend_more_than_cash(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 1.0, float(e), float(e), float(p), 0, 5.0) for i, (e, p) in enumerate(zip(rng.uniform(50, 5000, 200), rng.uniform(0.2, 90, 200)))]
    df = spark.createDataFrame(rows, "id long, weight double, equity double, cash double, open double, held long, volume double")
    for r in strategy.order_sizes(df, 1.0, 5.0, 2.0).collect():
        assert r.filled * r.price + r.fee <= r.cash + 1e-9
        more = r.filled + 1
        assert r.filled == r.wanted or more * r.price + 1.0 + more * r.price * 5e-4 > r.cash - 1e-6


def test_recipes(spark):
    assert registry.load('[{"name": "scale_prices", "config": {"factor": 2.0}}]').fingerprint() != registry.load('[{"name": "scale_prices", "config": {"factor": 3.0}}]').fingerprint()
    with pytest.raises(ValueError):
        registry.build("unknown")
    with pytest.raises(ValueError):
        registry.load('[{"name": "adjust_actions", "config": {"events": "$e", "reference_date": "2024-01-01"}}]', e=spark.range(1)).run(spark.range(1), Contract("1d", adjusted=True))
    with pytest.raises(ValueError):
        validate.scale_prices(spark.range(1), -1)


def test_stream_closes_bars_by_watermark(spark, tmp_path):
    rows = [("A", dt(2024, 1, 2, 14, m), m, 10.0 + m, 1.0) for m in (0, 1, 4, 5, 9, 30)]
    source = str(tmp_path / "in")
    utc(spark).createDataFrame(rows, "symbol string, ts timestamp, sequence long, price double, size double").write.parquet(source)
    trades = spark.readStream.schema("symbol string, ts timestamp, sequence long, price double, size double").parquet(source)
    q = stream_bars(trades, 5).writeStream.format("memory").queryName("closed_bars").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = spark.table("closed_bars").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(10.0, 14.0, 10.0, 14.0, 3.0), (15.0, 19.0, 15.0, 19.0, 2.0)]


@pytest.mark.parametrize("rule", ["and", "or"])
def test_redundant_intervals_against_a_loop(spark, rule):
    from barspark.operators.research import suppress_redundant

    rng = np.random.default_rng(3)
    rows = [("A", int(s), int(s + n), float(d), float(c)) for s, n, d, c in zip(rng.integers(0, 300, 150), rng.integers(8, 60, 150), rng.choice([-1.0, 1.0], 150), rng.random(150).round(6))]
    got = sorted((r.direction, r.start_rn, r.end_rn) for r in suppress_redundant(spark.createDataFrame(rows, "symbol string, start_rn long, end_rn long, direction double, clarity double"), rule=rule).collect())
    want = []
    for d in (-1.0, 1.0):
        kept = []
        for _, s, e, _, c in sorted((r for r in rows if r[3] == d), key=lambda r: (r[2], -r[4], r[1])):
            room = lambda k: max(500.0, (min(k[1] - k[0], e - s) + 1) * 5.0)  # noqa: B023, E731
            both = all if rule == "and" else any
            if not any(both((100 * abs(k[0] - s) <= room(k), 100 * abs(k[1] - e) <= room(k))) for k in kept):
                kept.append((s, e))
        want += [(d, *k) for k in kept]
    assert got == sorted(want)
