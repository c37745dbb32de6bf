"""Queries on validation, sessions and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import resample, validate
from barspark.operators import sessions as cal
from barspark.queries import SESSIONS_SQL, event_bars_sql, query, sessions, ship_bars_sql
from barspark.schema import PRICES
from barspark.sources.bars import event_bars, read, ship_bars

H = event_bars_sql("hour")
D = event_bars_sql("day")
S = ship_bars_sql()


def t():
    return F.unix_seconds("ts").alias("t")


def prices(*more):
    return [F.round(c, 6).alias(c) for c in (*PRICES, *more)]


PRICES_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in PRICES)


def raw_bars(spark, sf_dir):
    """Events as bars with faults: every value as it is, so zeros and disorder stay."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    v = F.col("value")
    k = F.col("event_id")
    return e.select(
        F.when(k % 50 == 0, F.concat(F.lit(" "), "event_type")).otherwise(F.col("event_type")).alias("symbol"), F.date_trunc("minute", "ts").alias("ts"), v.alias("open"),
        F.when(k % 11 == 0, v - 1).otherwise(v + 1).alias("high"), F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, F.lit(float("nan"))).otherwise(v - 1).alias("low"),
        F.when(k % 19 == 0, F.lit(None)).otherwise(v).alias("close"), F.when(k % 23 == 0, -v).otherwise(F.floor("value").cast("double")).alias("volume"), k.alias("sequence"),
    )


RAW = """raw AS (
  SELECT CASE WHEN event_id % 50 = 0 THEN ' ' || event_type ELSE event_type END AS symbol, date_trunc('minute', ts) AS ts, value AS open,
    CASE WHEN event_id % 11 = 0 THEN value - 1 ELSE value + 1 END AS high,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'nan'::DOUBLE ELSE value - 1 END AS low,
    CASE WHEN event_id % 19 = 0 THEN NULL ELSE value END AS close, CASE WHEN event_id % 23 = 0 THEN -value ELSE floor(value) END AS volume, event_id AS sequence
  FROM events
)"""
_rules = [(f"{c}_missing", f"{c} IS NULL") for c in (*PRICES, "volume")] + [(f"{c}_not_finite", f"{c} IS NOT NULL AND NOT isfinite({c})") for c in (*PRICES, "volume")]
_rules += [(f"{c}_not_positive", f"coalesce({c} <= 0, false)") for c in PRICES] + [("volume_negative", "coalesce(volume < 0, false)")]
_rules += [(f"{a}_above_{b}", f"coalesce({a} > {b}, false)") for a, b in (("low", "high"), ("low", "open"), ("open", "high"), ("low", "close"), ("close", "high"))]
RULES = ", ".join(f"('{name}', {broken})" for name, broken in _rules)
WHY = "concat_ws('+', " + ", ".join(f"CASE WHEN {broken} THEN '{name}' END" for name, broken in _rules) + ")"


@query(f"WITH {H} SELECT symbol, epoch(ts)::BIGINT AS t, {PRICES_SQL}, volume FROM bars WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def a01_scan(spark, sf_dir):
    return validate.between(event_bars(spark, sf_dir), "2024-01-05", "2024-01-20").select("symbol", t(), *prices(), "volume")


@query(f"WITH {RAW} SELECT rule AS reason, count(*) AS bars FROM raw, LATERAL (SELECT * FROM (VALUES {RULES}) v(rule, broken)) WHERE broken GROUP BY rule")
def b03_violation_report(spark, sf_dir):
    return validate.violation_report(raw_bars(spark, sf_dir))


@query(f"WITH {RAW}, bad AS (SELECT symbol, ts, sequence, string_agg(rule, ', ' ORDER BY rule) AS reasons FROM raw, LATERAL (SELECT * FROM (VALUES {RULES}) v(rule, broken)) WHERE broken GROUP BY 1, 2, 3) SELECT sequence, reasons FROM bad")
def b02_bar_flags(spark, sf_dir):
    return validate.flag_bars(raw_bars(spark, sf_dir)).where(F.size("reasons") > 0).select("sequence", F.array_join(F.array_sort("reasons"), ", ").alias("reasons"))


@query(f"WITH {RAW} SELECT symbol, epoch(ts)::BIGINT AS t, count(*) AS times FROM raw GROUP BY symbol, ts HAVING count(*) > 1")
def b04_duplicate_keys(spark, sf_dir):
    return validate.duplicate_keys(raw_bars(spark, sf_dir)).select("symbol", t(), "times")


@query(f"WITH {RAW}, x AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY (sequence * 7919) % 1000, sequence) AS before FROM raw) SELECT sequence, epoch(before)::BIGINT AS before FROM x WHERE ts < before")
def b05_order_breaks(spark, sf_dir):
    arrived = raw_bars(spark, sf_dir).withColumn("arrival", F.struct((F.col("sequence") * 7919 % 1000).alias("batch"), "sequence"))
    return validate.order_breaks(arrived, "arrival").select("sequence", F.unix_seconds("before").alias("before"))


@query(f"WITH {RAW} SELECT symbol, count(*) AS n FROM raw WHERE symbol IS NULL OR trim(symbol) <> symbol OR trim(symbol) = '' GROUP BY symbol")
def b06_bad_symbols(spark, sf_dir):
    return validate.bad_symbols(raw_bars(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("n"))


_SHOWN = " || ', ' || ".join(f"'{c}=' || CASE WHEN {c} IS NULL THEN 'null' WHEN isnan({c}) THEN 'NaN' ELSE {c}::DECIMAL(18,4)::VARCHAR END" for c in (*PRICES, "volume"))


@query(f"WITH {RAW}, f AS (SELECT *, {WHY} AS why FROM raw) SELECT symbol, epoch(ts)::BIGINT AS t, CASE WHEN why = '' THEN 'kept' ELSE why || ': ' || {_SHOWN} END AS outcome, count(*) AS n FROM f GROUP BY 1, 2, 3")
def b07_skip_invalid(spark, sf_dir):
    good, bad = validate.skip_invalid(raw_bars(spark, sf_dir))
    both = good.select("symbol", t(), F.lit("kept").alias("outcome")).union(bad.select("symbol", t(), "reason"))
    return both.groupBy("symbol", "t", "outcome").agg(F.count("*").alias("n"))


@query("SELECT event_id AS sequence FROM events WHERE NOT (event_id % 6 = 0 OR event_id % 15 = 0)")
def b08_skip_empty(spark, sf_dir):
    holes = raw_bars(spark, sf_dir).withColumns({c: F.when(F.col("sequence") % 6 == 0, F.lit(None).cast("double")).when(F.col("sequence") % 15 == 0, F.lit(float("nan"))).otherwise(F.col("open")) for c in PRICES})
    return validate.skip_empty(holes).select("sequence")


@query(f"WITH {RAW} SELECT sequence FROM raw WHERE volume <> floor(volume)")
def b09_fractional_volumes(spark, sf_dir):
    return validate.fractional_volumes(raw_bars(spark, sf_dir)).select("sequence")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, (l_orderkey % 900) * 9007199254740993 + l_linenumber AS big FROM lineitem) WHERE big::DOUBLE::HUGEINT <> big::HUGEINT")
def b10_lossy_numbers(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("big", F.expr("(l_orderkey % 900) * 9007199254740993 + l_linenumber"))
    return validate.lossy_numbers(rows, "big").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"WITH {H} SELECT symbol, count(*) AS n FROM bars WHERE ts <> date_trunc('day', ts) GROUP BY symbol")
def b12_not_midnight(spark, sf_dir):
    return validate.not_midnight(event_bars(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("n"))


_LOCAL = "timezone('America/New_York', timezone('UTC', ts))"


@query(f"WITH {H} SELECT symbol, epoch(ts)::BIGINT AS t FROM bars WHERE date_part('hour', {_LOCAL}) >= 20 OR date_part('hour', {_LOCAL}) < 4")
def b13_clock_window(spark, sf_dir):
    return validate.clock_window(event_bars(spark, sf_dir), "20:00", "04:00", "America/New_York").select("symbol", t())


@query("SELECT event_id FROM events WHERE epoch_ms(ts) % 60000 <> 0")
def b14_off_grid(spark, sf_dir):
    return validate.off_grid(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("event_id")


@query(f"WITH {H} SELECT symbol, epoch(ts)::BIGINT AS t, {', '.join(f'round({c} * 1.25, 6) AS {c}' for c in PRICES)}, volume FROM bars")
def b16_scale_prices(spark, sf_dir):
    return validate.scale_prices(event_bars(spark, sf_dir), 1.25).select("symbol", t(), *prices(), "volume")


@query(f"WITH {H}, a AS (SELECT symbol, ts FROM bars WHERE close > open), b AS (SELECT symbol, ts FROM bars WHERE volume > 1) SELECT symbol, epoch(ts)::BIGINT AS t, 'lost' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT symbol, epoch(ts)::BIGINT, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def b17_key_changes(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    return validate.key_changes(bars.where("close > open"), bars.where("volume > 1")).select("symbol", t(), "side")


@query(f"WITH {S} SELECT symbol, epoch(ts)::BIGINT AS t FROM bars WHERE epoch(timezone('America/New_York', (date_trunc('week', ts) + INTERVAL 7 DAY)::TIMESTAMP)) <= epoch(TIMESTAMP '1995-06-15')")
def b19_completed_weeks(spark, sf_dir):
    return validate.completed(ship_bars(spark, sf_dir), 1, "wk", "1995-06-15").select("symbol", t())


@query(f"WITH {H}, x AS (SELECT symbol, ts, {_LOCAL} AS l, lag({_LOCAL}) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars) SELECT symbol, epoch(ts)::BIGINT AS t, strftime(l, '%Y-%m-%d %H:%M:%S') AS display, coalesce(l <= p, false) AS repeated FROM x")
def b26_local_times(spark, sf_dir):
    return validate.local_times(event_bars(spark, sf_dir), "America/New_York").select("symbol", t(), "display", "repeated")


@query("SELECT count(DISTINCT (l_returnflag, l_linestatus)) AS identities FROM lineitem")
def a02_mixed_identity(spark, sf_dir):
    return validate.mixed_identity(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(f"WITH {H}, {SESSIONS_SQL} SELECT b.symbol, epoch(b.ts)::BIGINT AS t, strftime(label, '%Y-%m-%d') AS label FROM bars b ASOF LEFT JOIN sessions s ON b.ts >= s.open_ts WHERE b.ts < s.close_ts")
def c01_session_join(spark, sf_dir):
    found = cal.assign(event_bars(spark, sf_dir), sessions(spark)).where("label is not null")
    return found.select("symbol", t(), F.col("label").cast("string").alias("label"))


_BUCKET = """inside AS (
  SELECT b.*, label, open_ts, close_ts, to_timestamp(epoch(open_ts) + floor((epoch(b.ts) - epoch(open_ts)) / {s}) * {s})::TIMESTAMP AS start
  FROM bars b JOIN sessions s ON b.ts >= open_ts AND b.ts < close_ts
), grouped AS (
  SELECT symbol, label, start, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, count(*) AS observed,
    ceil((least(epoch(start) + {s}, epoch(any_value(close_ts))) - epoch(start)) / {m})::BIGINT AS expected
  FROM inside GROUP BY 1, 2, 3
)"""
M = event_bars_sql("minute")


@query(f"WITH {M}, {SESSIONS_SQL}, {_BUCKET.format(s=3600, m=60)} SELECT symbol, epoch(start)::BIGINT AS t, {PRICES_SQL}, volume, expected, observed FROM grouped")
def d01_resample_intraday(spark, sf_dir):
    found = resample.resample_sessions(event_bars(spark, sf_dir, "minute"), sessions(spark), 60, 1, "aggregate")
    return found.select("symbol", t(), *prices(), "volume", "expected", "observed")


@query(f"WITH {H}, {SESSIONS_SQL}, {_BUCKET.format(s=10800, m=3600)} SELECT symbol, epoch(start)::BIGINT AS t, {PRICES_SQL}, volume FROM grouped WHERE observed = expected")
def d02_drop_incomplete(spark, sf_dir):
    return resample.resample_sessions(event_bars(spark, sf_dir), sessions(spark), 180, 60, "drop").select("symbol", t(), *prices(), "volume")


@query(f"WITH {M}, {SESSIONS_SQL}, {_BUCKET.format(s=1800, m=60)} SELECT symbol, epoch(start)::BIGINT AS t, {PRICES_SQL}, volume FROM grouped")
def d03_resample_30m(spark, sf_dir):
    found = resample.resample_regular_hours(event_bars(spark, sf_dir, "minute"), sessions(spark), sessions(spark), "aggregate")
    return found.select("symbol", t(), *prices(), "volume")


_DAYS = "sessions AS (SELECT DISTINCT ts::DATE AS label, ts::DATE::TIMESTAMP AS open_ts, ts::DATE::TIMESTAMP + INTERVAL 1 DAY AS close_ts FROM bars)"


@query(f"WITH {H}, {_DAYS}, {_BUCKET.format(s=86400, m=3600)} SELECT symbol, strftime(label, '%Y-%m-%d') AS label, {PRICES_SQL}, volume FROM grouped WHERE observed = expected")
def d05_hourly_to_daily(spark, sf_dir):
    """Whole days as sessions, so that no bar is out of them; one that was would stop the job."""
    bars = event_bars(spark, sf_dir)
    opened = F.date_trunc("day", "ts")
    days = bars.select(F.to_date("ts").alias("label"), opened.alias("open_ts"), (opened + F.expr("INTERVAL 1 DAY")).alias("close_ts")).distinct()
    found = resample.resample_hourly_to_daily(bars, days, "drop")
    return found.select("symbol", F.col("label").cast("string").alias("label"), *prices(), "volume")


@query(f"WITH {H}, {SESSIONS_SQL}, {_BUCKET.format(s=86400, m=3600)} SELECT symbol, strftime(label, '%Y-%m-%d') AS label, {PRICES_SQL}, volume, expected, observed FROM grouped")
def d04_resample_daily(spark, sf_dir):
    found = resample.resample_sessions(event_bars(spark, sf_dir), sessions(spark), None, 60, "aggregate")
    return found.select("symbol", F.col("label").cast("string").alias("label"), *prices(), "volume", "expected", "observed")


@query(f"""WITH {H}, {SESSIONS_SQL}, grid AS (SELECT label, open_ts, close_ts, 7::BIGINT AS expected FROM sessions), due AS (SELECT * FROM (SELECT DISTINCT symbol FROM bars), grid)
SELECT d.symbol, strftime(label, '%Y-%m-%d') AS label, expected, count(b.ts) AS observed, expected - count(b.ts) AS missing
FROM due d LEFT JOIN bars b ON b.symbol = d.symbol AND b.ts >= open_ts AND b.ts < close_ts GROUP BY d.symbol, label, expected HAVING count(b.ts) <> expected""")
def d06_quality_report(spark, sf_dir):
    found = resample.quality_report(event_bars(spark, sf_dir), sessions(spark), None, 60)
    return found.select("symbol", F.col("label").cast("string").alias("label"), "expected", "observed", "missing")


@query(f"WITH {H}, {SESSIONS_SQL} SELECT b.symbol, count(*) FILTER (s.label IS NULL) AS outside FROM bars b LEFT JOIN sessions s ON b.ts >= open_ts AND b.ts < close_ts GROUP BY 1")
def d07_outside_count(spark, sf_dir):
    return resample.outside_count(event_bars(spark, sf_dir), sessions(spark))


@query(f"WITH {H}, {SESSIONS_SQL} SELECT symbol, epoch(ts)::BIGINT AS t FROM bars JOIN sessions ON ts >= open_ts AND ts < close_ts WHERE (epoch(ts) - epoch(open_ts))::BIGINT % 3600 <> 0")
def b15_off_session_grid(spark, sf_dir):
    return resample.off_session_grid(event_bars(spark, sf_dir), sessions(spark)).select("symbol", t())


@query(f"WITH {S}, x AS (SELECT *, (DATE '1970-01-05' + (floor(date_diff('day', DATE '1970-01-05', date_trunc('week', ts)::DATE) / 14) * 14)::INT)::DATE AS label FROM bars) SELECT symbol, strftime(label, '%Y-%m-%d') AS label, round(first(open ORDER BY ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY ts), 6) AS close, sum(volume) AS volume, count(*) AS bars FROM x GROUP BY 1, 2")
def d08_two_week_summary(spark, sf_dir):
    found = resample.calendar_summary(ship_bars(spark, sf_dir), 2)
    return found.select("symbol", F.col("label").cast("string").alias("label"), *prices(), "volume", "bars")


_RUNS = "runs AS (SELECT *, sum(CASE WHEN p IS NULL THEN 0 WHEN ts::DATE <> p::DATE OR epoch(ts) - epoch(p) > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars))"


@query(f"WITH {H}, {_RUNS}, x AS (SELECT *, (row_number() OVER (PARTITION BY symbol, run ORDER BY ts) - 1) // 4 AS step FROM runs) SELECT symbol, epoch(min(ts))::BIGINT AS t, round(first(open ORDER BY ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY ts), 6) AS close, sum(volume) AS volume, count(*) AS bars FROM x GROUP BY symbol, run, step")
def d09_step_bars(spark, sf_dir):
    return resample.step_bars(event_bars(spark, sf_dir), 4, 60).select("symbol", t(), *prices(), "volume", "bars")


@query(f"WITH {H}, {_RUNS} SELECT symbol, epoch(ts)::BIGINT AS t, run::BIGINT AS run FROM runs")
def e18_gap_runs(spark, sf_dir):
    return resample.gap_runs(event_bars(spark, sf_dir), 60).select("symbol", t(), "run")


_GRID = "grid AS (SELECT label, to_timestamp(s)::TIMESTAMP AS ts, least(to_timestamp(s + 3600)::TIMESTAMP, close_ts) AS end_ts FROM sessions, LATERAL (SELECT unnest(range(epoch(open_ts)::BIGINT, epoch(close_ts)::BIGINT, 3600)) AS s))"


@query(f"WITH {H}, {SESSIONS_SQL}, {_GRID}, g AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM grid), due AS (SELECT symbol, ts FROM (SELECT DISTINCT symbol FROM bars), g) SELECT symbol, epoch(ts)::BIGINT AS t, 'missing' AS state FROM (SELECT * FROM due EXCEPT SELECT symbol, ts FROM bars) UNION ALL SELECT symbol, epoch(ts)::BIGINT, 'unexpected' FROM bars WHERE ts NOT IN (SELECT ts FROM g)")
def c12_expected_and_actual(spark, sf_dir):
    grid = cal.expected_grid(sessions(spark), 60).select(F.date_trunc("hour", "ts").alias("ts")).distinct()
    return cal.missing_and_unexpected(event_bars(spark, sf_dir), grid).select("symbol", t(), "state")


@query(f"WITH {H}, {SESSIONS_SQL}, {_GRID} SELECT symbol, epoch(g.ts)::BIGINT AS t, epoch(g.end_ts)::BIGINT AS e FROM grid g JOIN bars b ON b.ts = date_trunc('hour', g.ts)")
def k01_expected_grid(spark, sf_dir):
    grid = cal.expected_grid(sessions(spark), 60).withColumnRenamed("ts", "g")
    found = event_bars(spark, sf_dir).join(grid, F.col("ts") == F.date_trunc("hour", "g"))
    return found.select("symbol", F.unix_seconds("g").alias("t"), F.unix_seconds("end_ts").alias("e"))


@query("""WITH days AS (SELECT DISTINCT ts::DATE AS label FROM events), x AS (
  SELECT label, timezone('America/New_York', label::TIMESTAMP + INTERVAL 570 MINUTE) AS o, timezone('America/New_York', label::TIMESTAMP + INTERVAL 960 MINUTE) AS c FROM days)
SELECT strftime(label, '%Y-%m-%d') AS label, epoch(o)::BIGINT AS o, epoch(c)::BIGINT AS c FROM x""")
def k02_local_sessions(spark, sf_dir):
    days = read(spark, sf_dir, "events").select(F.to_date("ts").alias("label")).distinct()
    found = cal.local_sessions(days, "America/New_York", "09:30:00", "16:00:00").where("valid")
    return found.select(F.col("label").cast("string").alias("label"), F.unix_seconds("open_ts").alias("o"), F.unix_seconds("close_ts").alias("c"))
