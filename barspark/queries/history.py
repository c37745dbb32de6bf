"""Queries on stored revisions, support history, calendars, identifiers and inferred metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions import indicators as ind
from barspark.operators import detect, resample, research, rollup, strategy, support, validate, vendor
from barspark.operators import sessions as cal
from barspark.plans import rebalance, strategies
from barspark.plans.pipeline import Contract, by_ticker, preview, registry
from barspark.queries import NUMBERED_SQL, SESSIONS_SQL, event_bars_sql, query, sessions, ship_bars_sql
from barspark.queries.bars import RAW, WHY, raw_bars
from barspark.queries.tables import _FLAT, EVENTS, events, flats
from barspark.queries.windows import _CHANGES, wilder_sql
from barspark.schema import PRICES, VALUES
from barspark.sources import payloads, store
from barspark.sources.bars import event_bars, read, ship_bars

H = event_bars_sql("hour")
S = ship_bars_sql()
P = "PARTITION BY symbol ORDER BY ts"
SPLIT = "1998-01-01"


def t(c="ts", name="t"):
    return F.unix_seconds(c).alias(name)


def shown(df, *names):
    return df.select("symbol", t(), *[F.round(c, 6).alias(c) for c in names or VALUES])


SHOWN = "symbol, epoch(ts)::BIGINT AS t, " + ", ".join(f"round({c}, 6) AS {c}" for c in VALUES)


def two_batches(spark, sf_dir):
    """A new store with the shipping bars before and from 1998 as ``early`` and ``late``."""
    bars, path = ship_bars(spark, sf_dir), store.scratch(spark, "bars")
    early, late = bars.where(F.col("ts") < SPLIT), bars.where(F.col("ts") >= SPLIT)
    store.write_batch(early, path, "raw", "desk", "1d", "early")
    store.write_batch(late, path, "raw", "desk", "1d", "late")
    return early, late, path


def all_of(spark, path, layer="raw", **more):
    return store.scan(spark, path, layer, "1d", "1990-01-01", "2010-01-01", **more)


_TIMES = ", ".join(f"{c} * (CASE WHEN ts >= TIMESTAMP '{SPLIT}' THEN 1.25 ELSE 1 END) AS {c}" for c in PRICES)


@query(f"WITH {S} SELECT {SHOWN} FROM bars")
def a07_checked_ingest(spark, sf_dir):
    """All bars as the answer to a request for their symbols and times."""
    bars, path = ship_bars(spark, sf_dir), store.scratch(spark, "bars")
    store.ingest(bars, path, "desk", "1d", "whole", ["AF", "AO", "NF", "NO", "RF", "RO"], "1990-01-01", "2010-01-01")
    return shown(all_of(spark, path))


@query(f"WITH {S} SELECT r.revision, count(b.ts) AS rows, 0 AS invalid, 0 AS repeated, true AS agrees FROM (VALUES ('early'), ('late'), ('fresh')) r(revision) JOIN bars b ON (b.ts < TIMESTAMP '{SPLIT}') = (r.revision = 'early') GROUP BY 1")
def a25_audit(spark, sf_dir):
    _, late, path = two_batches(spark, sf_dir)
    store.refresh(validate.scale_prices(late, 1.25), path, ["late"], "fresh")
    return store.audit(spark, path)


@query(f"WITH {S}, revised AS (SELECT symbol, ts, {_TIMES}, volume FROM bars) SELECT {SHOWN} FROM revised")
def a06_active_scan(spark, sf_dir):
    _, late, path = two_batches(spark, sf_dir)
    store.refresh(validate.scale_prices(late, 1.25), path, ["late"], "fresh")
    return shown(all_of(spark, path))


@query(f"WITH {S}, revised AS (SELECT symbol, ts, {_TIMES}, volume FROM bars WHERE ts >= TIMESTAMP '{SPLIT}' UNION ALL SELECT * FROM bars) SELECT {SHOWN} FROM revised")
def a06_scan_with_history(spark, sf_dir):
    _, late, path = two_batches(spark, sf_dir)
    store.refresh(validate.scale_prices(late, 1.25), path, ["late"], "fresh")
    return shown(all_of(spark, path, history=True))


@query(f"WITH {S} SELECT {SHOWN} FROM bars WHERE ts >= TIMESTAMP '{SPLIT}'")
def a03_historical_revision(spark, sf_dir):
    _, late, path = two_batches(spark, sf_dir)
    store.refresh(validate.scale_prices(late, 1.25), path, ["late"], "fresh")
    return shown(all_of(spark, path, revisions_=["late"]))


@query(f"WITH {S} SELECT {SHOWN} FROM bars")
def a04_raw_inputs(spark, sf_dir):
    _, _, path = two_batches(spark, sf_dir)
    return shown(store.read_inputs(spark, path, ["late", "early"]))


@query(f"WITH {S}, doubled AS (SELECT symbol, ts, {', '.join(f'2 * {c} AS {c}' for c in PRICES)}, volume FROM bars WHERE ts < TIMESTAMP '{SPLIT}') SELECT {SHOWN} FROM doubled")
def a08_processed_layer(spark, sf_dir):
    """What was processed from the refreshed batch is retired with it."""
    early, late, path = two_batches(spark, sf_dir)
    for name, bars in (("early", early), ("late", late)):
        store.write_processed(validate.scale_prices(bars, 2.0), path, [name], "doubled", f"doubled-{name}")
    store.refresh(late, path, ["late"], "fresh")
    return shown(all_of(spark, path, "processed", pipeline="doubled"))


@query(f"""WITH {S}, n AS (SELECT count(*) FILTER (ts < TIMESTAMP '{SPLIT}') AS a, count(*) FILTER (ts >= TIMESTAMP '{SPLIT}') AS b, min(ts) AS f, max(ts) AS l FROM bars), edges AS (SELECT max(ts) FILTER (ts < TIMESTAMP '{SPLIT}') AS before, min(ts) FILTER (ts >= TIMESTAMP '{SPLIT}') AS after FROM bars)
SELECT revision, active, rows, epoch(f)::BIGINT AS f, epoch(l)::BIGINT AS l FROM (SELECT 'early' AS revision, false AS active, a AS rows, f, before AS l FROM n, edges UNION ALL SELECT 'late', false, b, after, l FROM n, edges UNION ALL SELECT 'whole', true, a + b, f, l FROM n)""")
def a19_compacted(spark, sf_dir):
    _, _, path = two_batches(spark, sf_dir)
    store.compact(spark, path, ["early", "late"], "whole")
    return store.revisions(spark, path).select("revision", "active", "rows", t("first_ts", "f"), t("last_ts", "l"))


@query(f"WITH {S}, revised AS (SELECT symbol, ts, open, high, low, close, CASE WHEN ts < TIMESTAMP '{SPLIT}' THEN volume + 1 ELSE volume END AS volume FROM bars) SELECT {SHOWN} FROM revised")
def a20_replaced(spark, sf_dir):
    early, _, path = two_batches(spark, sf_dir)
    store.replace(early.withColumn("volume", F.col("volume") + 1), path, "early", "again")
    return shown(all_of(spark, path))


@query(f"WITH {S}, merged AS (SELECT symbol, ts, open, high, low, close, CASE WHEN ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1999-01-01' THEN volume * 3 ELSE volume END AS volume FROM bars) SELECT {SHOWN} FROM merged")
def a22_merged_gap(spark, sf_dir):
    bars, path = ship_bars(spark, sf_dir), store.scratch(spark, "bars")
    store.write_batch(bars.where("ts < '1997-01-01'"), path, "raw", "desk", "1d", "first")
    store.write_batch(bars.where("ts >= '1999-01-01'"), path, "raw", "desk", "1d", "last")
    gap = bars.where("ts >= '1997-01-01' and ts < '1999-01-01'").withColumn("volume", F.col("volume") * 3)
    chunks = [("1997-01-01", "1998-01-01", gap.where("ts < '1998-01-01'")), ("1998-01-01", "1999-01-01", gap.where("ts >= '1998-01-01'"))]
    store.merge(spark, path, ["first", "last"], chunks, "merged")
    return shown(all_of(spark, path))


START = "2024-01-10 07:00:00"
_INDEXED = f"indexed AS (SELECT *, row_number() OVER ({P}) - 1 - count(*) FILTER (ts < TIMESTAMP '{START}') OVER (PARTITION BY symbol) AS source_index FROM bars)"


@query(f"WITH {H}, {_INDEXED} SELECT symbol, epoch(ts)::BIGINT AS t, source_index, source_index < 0 AS is_support FROM indexed")
def b20_support_split(spark, sf_dir):
    return support.split_support(event_bars(spark, sf_dir), START).select("symbol", t(), F.col("source_index").cast("long").alias("source_index"), "is_support")


@query(f"WITH {H}, {NUMBERED_SQL} SELECT symbol, epoch(ts)::BIGINT AS t, 'lost' AS fault FROM numbered WHERE rn <= 14")
def b21_identity_breaks(spark, sf_dir):
    """The bars that an indicator without support loses to its warm-up."""
    bars = event_bars(spark, sf_dir)
    found = ind.rsi(ind.numbered(bars)).where("rsi is not null")
    return support.identity_breaks(bars, found).select("symbol", t(), "fault")


@query(f"WITH {H}, {_INDEXED} SELECT symbol, epoch(ts)::BIGINT AS t, source_index, round(close, 6) AS close FROM indexed WHERE source_index <= 40 AND ts <= TIMESTAMP '2024-01-11 12:00:00'")
def b22_as_of_slice(spark, sf_dir):
    found = support.as_of(support.split_support(event_bars(spark, sf_dir), START), index=40, ts="2024-01-11 12:00:00")
    return found.select("symbol", t(), F.col("source_index").cast("long").alias("source_index"), F.round("close", 6).alias("close"))


@query(f"""WITH RECURSIVE {H}, {NUMBERED_SQL}, {_CHANGES}, {wilder_sql('up', 'changes', 'gain', 15, 14)}, {wilder_sql('down', 'changes', 'loss', 15, 14)}
SELECT symbol, epoch(ts)::BIGINT AS t, round(CASE WHEN up + down = 0 THEN 0 ELSE 100 * up / (up + down) END, 6) AS rsi FROM numbered n LEFT JOIN up USING (symbol, rn) LEFT JOIN down USING (symbol, rn) WHERE ts >= TIMESTAMP '{START}'""")
def e12_rsi_with_support(spark, sf_dir):
    return shown(support.with_support(event_bars(spark, sf_dir), START, ind.rsi), "rsi")


@query(f"WITH {H}, {_INDEXED}, used AS (SELECT *, row_number() OVER ({P}) AS rn FROM indexed WHERE source_index >= -10), a AS (SELECT *, CASE WHEN rn >= 20 THEN avg(close) OVER ({P} ROWS 19 PRECEDING) END AS sma FROM used) SELECT symbol, epoch(ts)::BIGINT AS t, round(sma, 6) AS sma FROM a WHERE source_index >= 0")
def e12_sma_with_short_support(spark, sf_dir):
    return shown(support.with_support(event_bars(spark, sf_dir), START, lambda b: b.withColumn("sma", ind.sma("close", 20)), lookback=10), "sma")


@query(f"WITH {H} SELECT symbol, epoch(ts)::BIGINT AS t, round(close, 6) AS close, CASE WHEN ts >= TIMESTAMP '{START}' THEN volume END AS volume FROM bars")
def h02_stacked_support(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    before = F.col("ts") < F.lit(START).cast("timestamp")
    return shown(support.stacked(bars.where(before).drop("volume"), bars.where(~before)), "close", "volume")


@query("""WITH e AS (SELECT l_returnflag || l_linestatus AS symbol, l_orderkey, l_linenumber, l_partkey, l_commitdate AS a, l_receiptdate AS b FROM (SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey, l_shipdate AS l_commitdate, l_shipdate + INTERVAL (l_linenumber - 2) DAY AS l_receiptdate FROM lineitem))
SELECT symbol, CASE WHEN b < a THEN 'end before start' ELSE 'good' END AS fault, count(*) AS n, min(epoch(a))::BIGINT AS first FROM e GROUP BY 1, 2""")
def j21_event_table(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("a"), "l_linenumber")
    rows = rows.withColumn("b", F.timestamp_seconds(F.unix_seconds("a") + 86_400 * (F.col("l_linenumber") - 2)))
    found = support.event_table(rows, "a", "b")
    return found.groupBy("symbol", F.coalesce("fault", F.lit("good")).alias("fault")).agg(F.count("*").alias("n"), F.min(F.unix_seconds("a")).alias("first"))


_DAYS = "days AS (SELECT DISTINCT ts::DATE AS label FROM events)"
_NY = "timezone('America/New_York', timezone('UTC', {}))"


def event_days(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.to_date("ts").alias("label")).distinct()


@query(f"WITH {_DAYS}, {SESSIONS_SQL}, g AS (SELECT label, open_ts + INTERVAL (m) MINUTE AS ts FROM sessions JOIN days USING (label), range(0, 390, 30) r(m)) SELECT strftime(label, '%Y-%m-%d') AS label, epoch(ts)::BIGINT AS t FROM g WHERE strftime({_NY.format('ts')}, '%H:%M') < '10:00' OR strftime({_NY.format('ts')}, '%H:%M') >= '15:30'")
def k03_removed_by_window(spark, sf_dir):
    own = sessions(spark).join(event_days(spark, sf_dir), "label", "left_semi")
    found = cal.removed_by_window(own, 30, "10:00", "15:30", "America/New_York")
    return found.select(F.col("label").cast("string").alias("label"), t())


@query(f"WITH {_DAYS}, {SESSIONS_SQL}, o AS (SELECT label, timezone('America/New_York', label::TIMESTAMP + INTERVAL 570 MINUTE) AS a, timezone('America/New_York', label::TIMESTAMP + CASE WHEN day(label) % 5 = 0 THEN INTERVAL 780 MINUTE ELSE INTERVAL 960 MINUTE END) AS b FROM days) SELECT strftime(o.label, '%Y-%m-%d') AS label FROM o LEFT JOIN sessions s ON s.label = o.label AND epoch(s.open_ts) = epoch(o.a) AND epoch(s.close_ts) = epoch(o.b) WHERE s.label IS NULL")
def k04_calendar_mismatches(spark, sf_dir):
    days = event_days(spark, sf_dir)
    five = F.dayofmonth("label") % 5 == 0
    outputs = cal.local_sessions(days.where(~five), "America/New_York", "09:30:00", "16:00:00").union(cal.local_sessions(days.where(five), "America/New_York", "09:30:00", "13:00:00"))
    return cal.calendar_mismatches(outputs, sessions(spark)).select(F.col("label").cast("string").alias("label"))


@query(f"WITH {H}, early AS (SELECT ts::DATE AS label FROM events GROUP BY 1 HAVING count(*) % 2 = 0) SELECT symbol, epoch(ts)::BIGINT AS t FROM bars b LEFT JOIN early e ON e.label = {_NY.format('b.ts')}::DATE WHERE hour({_NY.format('b.ts')}) BETWEEN 9 AND 15 AND (e.label IS NULL OR b.ts < e.label::TIMESTAMP + INTERVAL 18 HOUR)")
def b23_trading_period(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("label")).count().where("count % 2 = 0")
    early = days.select("label", F.col("label").cast("timestamp").alias("_at")).select("label", (F.col("_at") + F.expr("INTERVAL 18 HOURS")).alias("close_ts"))
    return cal.trading_period(event_bars(spark, sf_dir), early).select("symbol", t())


@query(f"WITH {_DAYS}, {H}, {SESSIONS_SQL}, n AS (SELECT label, close_ts, lead(label) OVER (ORDER BY label) AS following FROM sessions), due AS (SELECT symbol, d.label AS ex_date, (SELECT max(close_ts) FROM n WHERE n.label < d.label) AS closed FROM days d, (SELECT DISTINCT symbol FROM bars)) SELECT due.symbol, strftime(ex_date, '%Y-%m-%d') AS ex_date, round(close, 6) AS reference_close FROM due LEFT JOIN bars b ON b.symbol = due.symbol AND b.ts = due.closed - INTERVAL 90 MINUTE + INTERVAL 30 MINUTE")
def c14_close_before(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    dates = bars.select("symbol").distinct().crossJoin(F.broadcast(event_days(spark, sf_dir).withColumnRenamed("label", "ex_date")))  # a row a day
    found = cal.close_before(dates, bars, sessions(spark), 60)
    return found.select("symbol", F.col("ex_date").cast("string").alias("ex_date"), F.round("reference_close", 6).alias("reference_close"))


@query(f"WITH {RAW} SELECT sequence FROM raw WHERE NOT coalesce(isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND low <= high AND low <= open AND open <= high AND low <= close AND close <= high, false)")
def b25_detector_faults(spark, sf_dir):
    return validate.detector_faults(raw_bars(spark, sf_dir)).select("sequence")


@query(f"WITH {RAW}, {SESSIONS_SQL}, bad AS (SELECT * FROM raw WHERE NOT coalesce(isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) AND isfinite(volume) AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND low <= high AND low <= open AND open <= high AND low <= close AND close <= high, false)), out AS (SELECT DISTINCT symbol, ts FROM bad b WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE b.ts < s.close_ts AND b.ts + INTERVAL 30 MINUTE > s.open_ts)) SELECT sequence FROM raw r WHERE NOT EXISTS (SELECT 1 FROM out o WHERE o.symbol = r.symbol AND o.ts = r.ts)")
def b18_invalid_outside_sessions(spark, sf_dir):
    return validate.drop_invalid_outside(raw_bars(spark, sf_dir), sessions(spark), 30).select("sequence")


@query("SELECT o_orderpriority AS id, url_encode(o_orderpriority || '/~*' || o_clerk_) AS encoded, count(*) AS n FROM (SELECT o_orderpriority, o_orderstatus AS o_clerk_ FROM orders) GROUP BY 1, 2")
def s13_encoded(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("encoded", validate.encoded(F.concat("o_orderpriority", F.lit("/~*"), "o_orderstatus")))
    return o.groupBy(F.col("o_orderpriority").alias("id"), "encoded").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT p_partkey, p_size || (['m', 'h', 'd', 'wk', 'mo', 'y'])[p_partkey % 6 + 1] AS text, p_size AS n, (['m', 'h', 'd', 'wk', 'mo', 'y'])[p_partkey % 6 + 1] AS unit FROM (SELECT p_partkey, p_size * 15 AS p_size FROM part)), a AS (SELECT *, CASE WHEN unit = 'm' AND n % 60 = 0 THEN 'h' ELSE unit END AS u, CASE WHEN unit = 'm' AND n % 60 = 0 THEN n // 60 ELSE n END AS k FROM x)
SELECT p_partkey, CASE WHEN unit = 'y' THEN 'none' ELSE k || u END AS canonical, CASE WHEN unit = 'y' THEN NULL ELSE k * CASE u WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 WHEN 'wk' THEN 604800 END END AS seconds FROM a""")
def s17_timeframes(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ["m", "h", "d", "wk", "mo", "y"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = read(spark, sf_dir, "part").withColumn("tf", validate.timeframe(F.concat((F.col("p_size") * 15).cast("string"), unit)))
    return p.select("p_partkey", F.coalesce(F.concat(F.col("tf.amount").cast("string"), "tf.unit"), F.lit("none")).alias("canonical"), F.col("tf.seconds").alias("seconds"))


@query("""WITH o AS (SELECT o_custkey AS ticker, o_orderstatus AS s, o_totalprice AS p FROM orders)
SELECT ticker, 'outcomes' AS "table", s AS metric, count(*)::DOUBLE AS value, 'sum' AS aggregation FROM o GROUP BY 1, 3
UNION ALL SELECT ticker, 'run statistics', 'win_count', count(*) FILTER (s = 'F')::DOUBLE, 'sum' FROM o GROUP BY 1
UNION ALL SELECT ticker, 'run statistics', 'share', round(avg((s = 'F')::INT), 9), 'none' FROM o GROUP BY 1
UNION ALL SELECT ticker, 'best', 'score', round(max(p), 9), 'none' FROM o WHERE s = 'P' GROUP BY 1 HAVING count(*) = 1""")
def d13_inferred_metrics(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"), "o_orderdate")
    won = F.col("s") == "F"
    tables = {
        "outcomes": o.groupBy("ticker", F.col("s").alias("outcome")).agg(F.count("*").alias("count")),
        "run statistics": o.groupBy("ticker").agg(F.count_if(won).alias("win_count"), F.avg(won.cast("int")).alias("share"), F.max("p").alias("last_price"), F.max("o_orderdate").alias("end_date")),
        "best": o.where("s = 'P'").select("ticker", F.col("p").alias("score"), F.lit(True).alias("flag")),
        "orders": o.select("ticker", F.col("o_orderdate").alias("date"), F.col("p").alias("score")),
    }
    tables["outcomes"] = rollup.with_roles(tables["outcomes"], outcome="category", count="count")
    tables["run statistics"] = rollup.with_roles(tables["run statistics"], win_count="count", last_price="price")
    found = rollup.inferred_metrics(tables, summaries=("run statistics",))
    return found.withColumn("value", F.round("value", 9))


@query(f"WITH {H}, {NUMBERED_SQL}, m AS (SELECT *, close / lag(close, 5) OVER ({P}) - 1 AS slow, close / lag(close, 2) OVER ({P}) - 1 AS fast FROM numbered) SELECT symbol, epoch(ts)::BIGINT AS t, round(fast - slow, 6) AS lead, coalesce(fast > slow, false) AS signal FROM m")
def u09_features(spark, sf_dir):
    bars = support.features(event_bars(spark, sf_dir), {"fast": ind.momentum(2), "slow": ind.momentum(5)})
    found = support.features(bars, {"lead": F.col("fast") - F.col("slow"), "signal": F.coalesce(F.col("fast") > F.col("slow"), F.lit(False))})
    return found.select("symbol", t(), F.round("lead", 6).alias("lead"), "signal")


@query(f"{_FLAT} SELECT f.symbol, epoch(n.ts)::BIGINT AS t, end_rn - start_rn + 1 AS bars FROM flat f JOIN numbered n ON n.symbol = f.symbol AND n.rn = f.end_rn WHERE hour(n.ts) = 12")
def f08_replay(spark, sf_dir):
    cutoffs = event_bars(spark, sf_dir).where(F.hour("ts") == 12).select("symbol", F.col("ts").alias("end_ts"))
    found = support.replay(flats(spark, sf_dir), cutoffs)
    return found.select("symbol", F.unix_seconds("end_ts").alias("t"), F.col("bars").cast("long").alias("bars"))


_TABLE = """WITH o AS (SELECT o_orderstatus || o_orderpriority[1] AS ts, o_custkey AS symbol, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE max(o_totalprice) END AS score, sum(o_totalprice) AS held, count(*) AS asked FROM orders GROUP BY 1, 2), w AS (
  SELECT ts, symbol, score, 0.9 * held / sum(held) OVER (PARTITION BY ts) AS current, asked::DOUBLE / sum(asked) OVER (PARTITION BY ts) AS proposed FROM o
), a AS (
  SELECT *, score IS NULL AND current > 0 AS frozen, CASE WHEN score IS NULL THEN 0.0 ELSE proposed END AS relative FROM w
), b AS (
  SELECT *, coalesce(sum(CASE WHEN frozen THEN current END) OVER p, 0) AS f, sum(relative) OVER p AS asked FROM a WINDOW p AS (PARTITION BY ts)
), c AS (
  SELECT *, greatest(0, 1 - {reserve} - f) AS room, least(greatest(0, 1 - {reserve} - f), asked) AS usable, row_number() OVER (PARTITION BY ts ORDER BY relative DESC, symbol) AS k FROM b
), d AS (
  SELECT *, sum(relative) OVER (PARTITION BY ts ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS tail FROM c
), e AS (
  SELECT *, min(CASE WHEN relative * (usable - (k - 1) * {cap}) <= {cap} * tail THEN k END) OVER (PARTITION BY ts) AS first FROM d
), g AS (
  SELECT *, sum(CASE WHEN k >= first THEN relative ELSE 0 END) OVER (PARTITION BY ts) AS free FROM e
), h AS (
  SELECT *, CASE WHEN frozen THEN current WHEN k >= first THEN CASE WHEN free = 0 THEN 0 ELSE relative / free * (usable - (first - 1) * {cap}) END ELSE {cap} END AS wish, CASE WHEN frozen THEN current ELSE least(current, {cap}) END AS base0 FROM g
), i AS (
  SELECT *, sum(CASE WHEN frozen THEN 0 ELSE base0 END) OVER (PARTITION BY ts) AS held FROM h
), j AS (
  SELECT *, CASE WHEN NOT frozen AND held > room THEN base0 * room / held ELSE base0 END AS base FROM i
), l AS (
  SELECT *, CASE WHEN NOT frozen AND wish > 0 AND abs(wish - base) < {least} THEN base ELSE wish END AS wish1, sum(abs(base - current)) OVER (PARTITION BY ts) AS must FROM j
), m AS (
  SELECT *, sum(greatest(0, base - wish1)) OVER p AS sold, sum(greatest(0, wish1 - base)) OVER p AS bought, sum(base) OVER p AS based FROM l WINDOW p AS (PARTITION BY ts)
), n AS (
  SELECT *, CASE WHEN bought > greatest(0, 1 - {reserve} - based) + sold + 1e-12 AND wish1 > base THEN base + (wish1 - base) * (greatest(0, 1 - {reserve} - based) + sold) / bought ELSE wish1 END AS wish2 FROM m
), q AS (
  SELECT *, sum(abs(wish2 - base)) OVER (PARTITION BY ts) AS moves, greatest(0, {turnover} - must) AS rest FROM n
)
SELECT ts AS at, symbol, frozen, round(current, 9) AS current, round(CASE WHEN moves > rest + 1e-12 THEN base + rest / moves * (wish2 - base) ELSE wish2 END, 9) AS target,
  concat_ws('; ', CASE WHEN frozen THEN 'frozen: no score' END, CASE WHEN NOT frozen AND relative > 0 THEN 'selected' END, CASE WHEN NOT frozen AND relative = 0 THEN 'not selected' END,
    CASE WHEN NOT frozen AND coalesce(relative / nullif(asked, 0), 0) * usable + 1e-12 < coalesce(proposed, 0) THEN 'reduced for reserve and frozen holdings' END, CASE WHEN NOT frozen AND wish + 1e-12 < coalesce(relative / nullif(asked, 0), 0) * usable THEN 'reduced by cap' END,
    CASE WHEN frozen AND f > 1 - {reserve} + 1e-12 THEN 'frozen holdings exceed the reserve' END, CASE WHEN abs(base - current) > 1e-12 THEN 'mandatory reduction' END, CASE WHEN abs(base - current) > 1e-12 AND must > {turnover} + 1e-12 THEN 'mandatory changes exceed the turnover budget' END,
    CASE WHEN NOT frozen AND wish > 0 AND abs(wish - base) < {least} THEN 'change below the least' END, CASE WHEN bought > greatest(0, 1 - {reserve} - based) + sold + 1e-12 AND wish1 > base THEN 'reduced to keep the reserve' END, CASE WHEN moves > rest + 1e-12 AND abs(wish2 - base) > 1e-12 THEN 'limited by the turnover budget' END) AS reason FROM q"""


@query(_TABLE.format(reserve=0.05, cap=0.02, turnover=0.5, least=0.0005))
def j10_decision_table(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("ts"), F.col("o_custkey").alias("symbol")).agg(F.max("o_totalprice").alias("score"), F.sum("o_totalprice").alias("held"), F.count("*").alias("asked"))
    part = lambda c: F.col(c) / F.sum(c).over(ind.Window.partitionBy("ts"))
    df = o.select("ts", "symbol", F.when(F.col("symbol") % 4 != 0, F.col("score")).alias("score"), (0.9 * part("held")).alias("current"), part("asked").alias("proposed"))
    found = strategy.rebalance_targets(df, reserve=0.05, cap=0.02, turnover=0.5, least=0.0005)
    return found.select(F.col("ts").alias("at"), "symbol", "frozen", F.round("current", 9).alias("current"), F.round("target", 9).alias("target"), "reason")


_W = ship_bars_sql("week", True)
_FLOW = f"""WITH {_W}, {NUMBERED_SQL}, days AS (SELECT ts, (row_number() OVER (ORDER BY ts) - 1) % 4 = 0 AS due FROM (SELECT DISTINCT ts FROM bars)), panel AS (SELECT symbol, ts, rn, close / lag(close, 4) OVER ({P}) - 1 AS score FROM numbered), scored AS (
  SELECT symbol, ts, score FROM panel JOIN days USING (ts) WHERE due AND rn >= 6 AND score IS NOT NULL), chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS place FROM scored) WHERE place <= 8 AND score > 0), proposed AS (SELECT ts, symbol, score / sum(score) OVER (PARTITION BY ts) AS proposed FROM chosen), state AS (
  SELECT ts, symbol, 0.9 * volume / sum(volume) OVER (PARTITION BY ts) AS current FROM bars JOIN days USING (ts) WHERE due), w AS (
  SELECT ts, symbol, score, coalesce(current, 0) AS current, coalesce(proposed, 0) AS proposed FROM scored FULL JOIN state USING (ts, symbol) LEFT JOIN proposed USING (ts, symbol)""" + _TABLE[_TABLE.index("\n), a AS ("):].replace("SELECT ts AS at, symbol,", "SELECT 'rebalance-' || lpad(dense_rank() OVER (ORDER BY ts)::VARCHAR, 6, '0') AS rebalance_id, epoch(ts)::BIGINT AS at, symbol,")


@query(_FLOW.format(reserve=0.05, cap=0.2, turnover=0.8, least=0.001))
def j10_rebalance_flow(spark, sf_dir):
    """Every fourth week: scores of four weeks, the eight best by score, against what was held."""
    bars = ind.numbered(ship_bars(spark, sf_dir, "week", True))
    panel = bars.withColumn("score", F.col("close") / F.lag("close", 4).over(ind.by_time()) - 1)
    held = bars.select("ts", "symbol", (0.9 * F.col("volume") / F.sum("volume").over(ind.Window.partitionBy("ts"))).alias("current"))
    due = rebalance.rebalances(bars, "every_n", 4)
    found = rebalance.decisions(panel, due, {"name": "top_n_score", "config": {"n": 8}}, held, lookback=6, reserve=0.05, cap=0.2, turnover=0.8, least=0.001)
    return found.select("rebalance_id", t("ts", "at"), "symbol", "frozen", F.round("current", 9).alias("current"), F.round("target", 9).alias("target"), "reason")


_RECORDS = """lines AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_shipdate) AS shipped, max(l_returnflag) AS flag, max(l_tax) AS tax, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), records AS (
  SELECT k % 97 AS security_id, k * 2 + n % 2 AS uid, k AS event_id, shipped + INTERVAL (n) SECOND AS ts_record, CASE flag WHEN 'A' THEN 'U' WHEN 'N' THEN 'I' ELSE 'C' END AS action, (['DIV', 'FSPLT', 'RSPLT', 'DIV', 'MRGR', 'SD'])[k % 6 + 1] AS event,
    CASE WHEN k % 6 = 1 AND k % 4 = 1 THEN 'BON' WHEN k % 6 = 3 AND k % 5 = 0 THEN 'CAPDIST' END AS subtype, CASE WHEN k % 7 = 0 THEN 'S' ELSE 'C' END AS payment, CASE WHEN k % 11 = 0 THEN 'SPL' END AS marker, k % 97 + CASE WHEN k % 5 = 1 THEN 0 ELSE 1 END AS outturn,
    (n % 3)::DOUBLE AS ratio_old, (q::BIGINT % 5)::DOUBLE AS ratio_new, round(tax * 100 - 1, 4) AS gross, CASE WHEN k % 13 = 0 THEN 'EUR' ELSE 'USD' END AS rate_currency, CASE WHEN k % 17 = 0 THEN 'EUR' ELSE 'USD' END AS trading_currency, (DATE '1995-01-01' + (k % 2000)::INT)::DATE AS ex_date FROM lines
), factors AS (
  SELECT k AS event_id, k % 97 AS security_id, CASE WHEN k % 19 = 0 THEN 'Y' ELSE 'X' END AS exchange, (DATE '1995-01-01' + (k % 2000)::INT)::DATE AS ex_date, created, factor, CASE WHEN k % 29 = 0 THEN 18 ELSE 17 END AS reason, status FROM (
    SELECT o_orderkey AS k, o_orderdate AS created, CASE WHEN o_custkey % 23 = 0 THEN 1.5 ELSE 0.9 + (o_custkey % 9) / 100.0 END::DOUBLE AS factor, CASE WHEN o_custkey % 8 = 0 THEN 'P' ELSE 'A' END AS status FROM orders
    UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY, CASE WHEN o_custkey % 23 = 0 THEN 1.5 ELSE 0.9 + (o_custkey % 9) / 100.0 END::DOUBLE, 'R' FROM orders WHERE o_totalprice > 250000
    UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 2 DAY, 0.8::DOUBLE, 'A' FROM orders WHERE o_orderpriority = '1-URGENT')
)"""
_FACTORED = """values_ AS (SELECT event_id, security_id, ex_date, factor, max(created) AS now, arg_max(status, created) AS status, count(*) FILTER (reason <> 17) AS odd FROM factors WHERE exchange = 'X' AND created <= TIMESTAMP '2001-01-01' GROUP BY 1, 2, 3, 4), live AS (
  SELECT event_id, security_id, ex_date, sum(odd) AS odd, count(*) FILTER (status <> 'R') AS live, coalesce(arg_max(factor, (now, status)) FILTER (status <> 'R'), arg_max(factor, (now, status))) AS factor, coalesce(arg_max(status, (now, status)) FILTER (status <> 'R'), arg_max(status, (now, status))) AS factor_status FROM values_ GROUP BY 1, 2, 3
), in_force AS (SELECT *, CASE WHEN odd > 0 THEN 'unsupported reason or currency' WHEN live > 1 THEN 'several values in force' END AS factor_fault FROM live)"""


def vendor_tables(spark, sf_dir):
    """Records and factors of a vendor, from order lines and orders."""
    k = F.col("l_orderkey")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_shipdate").cast("timestamp")).alias("at"), F.max("l_returnflag").alias("flag"), F.max("l_tax").alias("tax"), F.max("l_quantity").alias("q"))
    usd = lambda n, c: F.when(c % n == 0, "EUR").otherwise("USD")
    day = lambda c: F.date_add(F.lit("1995-01-01").cast("date"), (c % 2000).cast("int"))
    records = lines.select(
        F.concat(F.lit("s"), (k % 97).cast("string")).alias("symbol"), (k % 97).alias("security_id"), (k * 2 + F.col("l_linenumber") % 2).alias("event_unique_id"), k.alias("event_id"), F.timestamp_seconds(F.unix_seconds("at") + F.col("l_linenumber")).alias("ts_record"),
        F.when(F.col("flag") == "A", "U").when(F.col("flag") == "N", "I").otherwise("C").alias("event_action"), F.element_at(F.array(*map(F.lit, ("DIV", "FSPLT", "RSPLT", "DIV", "MRGR", "SD"))), (k % 6 + 1).cast("int")).alias("event"),
        F.when((k % 6 == 1) & (k % 4 == 1), "BON").when((k % 6 == 3) & (k % 5 == 0), "CAPDIST").alias("event_subtype"), F.when(k % 7 == 0, "S").otherwise("C").alias("payment_type"), F.when(k % 11 == 0, "SPL").alias("marker"),
        (k % 97 + F.when(k % 5 == 1, 0).otherwise(1)).alias("outturn_security_id"), (F.col("l_linenumber") % 3).cast("double").alias("ratio_old"), (F.col("q").cast("long") % 5).cast("double").alias("ratio_new"), F.round(F.col("tax") * 100 - 1, 4).alias("gross_dividend"),
        usd(13, k).alias("rate_currency"), usd(17, k).alias("trading_currency"), day(k).alias("ex_date"), F.lit(None).cast("date").alias("effective_date"), F.date_add(day(k), 1).alias("event_date"),
    )
    o, c = read(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp")), F.col("o_custkey")
    factor = F.when(c % 23 == 0, 1.5).otherwise(0.9 + (c % 9) / 100.0)
    one = lambda rows, days, f, status: rows.select(F.col("o_orderkey").alias("k"), F.timestamp_seconds(F.unix_seconds("at") + 86_400 * days).alias("ts_created"), f.cast("double").alias("factor"), status.alias("status"))
    rows = one(o, 0, factor, F.when(c % 8 == 0, "P").otherwise("A")).union(one(o.where("o_totalprice > 250000"), 1, factor, F.lit("R"))).union(one(o.where("o_orderpriority = '1-URGENT'"), 2, F.lit(0.8), F.lit("A")))
    k = F.col("k")
    factors = rows.select(k.alias("event_id"), (k % 97).alias("security_id"), F.when(k % 19 == 0, "Y").otherwise("X").alias("exchange"), day(k).alias("ex_date"), "ts_created", "factor", F.when(k % 29 == 0, 18).otherwise(17).alias("reason"), F.lit("USD").alias("dividend_currency"), F.lit(1).alias("option"), "status")
    return records, factors


@query(f"WITH {_RECORDS}, {_FACTORED} SELECT event_id, round(factor, 6) AS factor, factor_status, coalesce(factor_fault, 'good') AS fault FROM in_force")
def c10_dividend_factors(spark, sf_dir):
    found = vendor.dividend_factors(vendor_tables(spark, sf_dir)[1], "2001-01-01", "X")
    return found.select("event_id", F.round("factor", 6).alias("factor"), "factor_status", F.coalesce("factor_fault", F.lit("good")).alias("fault"))


@query(f"""WITH {_RECORDS}, {_FACTORED}, newest AS (SELECT *, count(*) OVER (PARTITION BY uid) AS revisions, row_number() OVER (PARTITION BY uid ORDER BY ts_record DESC) AS n FROM records WHERE ts_record <= TIMESTAMP '2001-01-01'), one AS (
  SELECT *, action <> 'C' AS live, count(*) FILTER (action <> 'C') OVER (PARTITION BY event_id) AS options, row_number() OVER (PARTITION BY event_id ORDER BY action <> 'C' DESC, uid) AS place FROM newest WHERE n = 1), typed AS (
  SELECT *, CASE WHEN event = 'FSPLT' AND subtype = 'BON' THEN CASE WHEN outturn = security_id THEN 'stock_dividend' ELSE 'unsupported_stock_distribution' END WHEN event IN ('FSPLT', 'SD') THEN 'forward_split' WHEN event = 'RSPLT' THEN 'reverse_split' WHEN event = 'MRGR' THEN 'merger'
    WHEN subtype = 'CAPDIST' THEN 'return_of_capital' WHEN payment = 'C' THEN CASE WHEN marker = 'SPL' THEN 'special_cash_dividend' ELSE 'cash_dividend' END ELSE 'unsupported_dividend' END AS kind FROM one WHERE place = 1), dated AS (
  SELECT *, kind IN ('forward_split', 'reverse_split', 'stock_dividend') AS split, kind IN ('cash_dividend', 'special_cash_dividend') AS paid, CASE WHEN kind IN ('forward_split', 'reverse_split', 'stock_dividend', 'cash_dividend', 'special_cash_dividend') THEN ex_date ELSE ex_date + 1 END AS effective FROM typed), joined AS (
  SELECT d.*, factor, factor_status, factor_fault, CASE WHEN split AND ratio_old > 0 AND ratio_new > 0 THEN ratio_new / ratio_old END AS shares FROM dated d LEFT JOIN in_force f ON f.event_id = d.event_id AND f.security_id = d.security_id AND f.ex_date = d.ex_date WHERE effective BETWEEN DATE '1995-06-01' AND DATE '1999-12-31'), judged AS (
  SELECT *, CASE WHEN options > 1 THEN 'several benefits' WHEN action = 'C' OR NOT (split OR paid) THEN NULL WHEN trading_currency <> 'USD' THEN 'trading currency' WHEN split AND shares IS NULL THEN 'no share ratio' WHEN paid AND rate_currency <> 'USD' THEN 'dividend currency' WHEN paid AND factor_status IS NULL THEN 'no factor'
    WHEN paid AND factor_fault IS NOT NULL THEN factor_fault WHEN paid AND factor_status = 'A' AND NOT (factor > 0 AND factor < 1) THEN 'factor out of range' WHEN paid AND gross <= 0 THEN 'amount not positive' END AS fault FROM joined)
SELECT event_id, kind AS event_type, strftime(effective, '%Y-%m-%d') AS effective, CASE WHEN fault IS NOT NULL THEN 'pending' WHEN action = 'C' THEN 'cancelled' WHEN paid AND factor_status <> 'A' THEN 'pending' ELSE 'apply' END AS status, coalesce(fault, 'good') AS fault, revisions,
  CASE WHEN fault IS NULL AND action <> 'C' AND split THEN round(shares, 6) END AS share_ratio, CASE WHEN fault IS NULL AND action <> 'C' AND paid THEN round(gross, 6) END AS cash, CASE WHEN fault IS NULL AND action <> 'C' AND split THEN round(1 / shares, 6) WHEN fault IS NULL AND action <> 'C' AND paid AND factor_status = 'A' THEN round(factor, 6) END AS price_factor FROM judged""")
def i09_resolved_events(spark, sf_dir):
    records, factors = vendor_tables(spark, sf_dir)
    found = vendor.resolved_events(records, factors, "1995-06-01", "1999-12-31", "2001-01-01", "X")
    return found.select(
        "event_id", "event_type", F.col("effective_date").cast("string").alias("effective"), "status", F.coalesce("fault", F.lit("good")).alias("fault"), "revisions",
        F.round("share_ratio", 6).alias("share_ratio"), F.round("cash_amount", 6).alias("cash"), F.round("price_factor", 6).alias("price_factor"),
    )


@query(f"""WITH {S}, m AS (SELECT min(ts) AS ts FROM bars GROUP BY date_trunc('month', ts)), g AS (SELECT ts, symbol, 0.9 * volume / sum(volume) OVER (PARTITION BY ts) AS weight, close AS base FROM bars JOIN m USING (ts)), seg AS (SELECT ts AS start, lead(ts) OVER (ORDER BY ts) AS until FROM m), times AS (SELECT DISTINCT b.ts, s.start FROM bars b JOIN seg s ON b.ts > s.start AND (until IS NULL OR b.ts <= until)), due AS (
  SELECT t.ts, t.start, g.symbol, weight, base FROM times t JOIN g ON g.ts = t.start), curve AS (SELECT d.start, d.ts, 1 + sum(weight * (close / base - 1)) AS growth FROM due d ASOF JOIN bars p ON p.symbol = d.symbol AND p.ts <= d.ts GROUP BY 1, 2), whole AS (SELECT start, arg_max(growth, ts) AS growth FROM curve GROUP BY 1),
scaled AS (SELECT start, exp(coalesce(sum(ln(growth)) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS scale FROM whole)
SELECT epoch(ts)::BIGINT AS t, round(ln(scale * growth), 6) AS log_equity FROM curve JOIN scaled USING (start) UNION ALL SELECT epoch(min(ts))::BIGINT, 0 FROM m""")
def j17_drifting_portfolio(spark, sf_dir):
    bars = ship_bars(spark, sf_dir)
    first = bars.groupBy(F.date_trunc("month", "ts").alias("m")).agg(F.min("ts").alias("ts")).select("ts")
    weights = bars.join(first, "ts", "left_semi").select("ts", "symbol", (0.9 * F.col("volume") / F.sum("volume").over(ind.Window.partitionBy("ts"))).alias("weight"))
    found = strategy.drifting_equity(bars, weights)
    return found.select(t(), F.round(F.log("equity"), 6).alias("log_equity"))


_NESTED = {"name": "weighted", "config": {"weights": [0.6, 0.4], "parts": [{"name": "average_crossing", "config": {"fast": 5, "slow": 20}}, {"name": "momentum", "config": {"lookback": 10}}]}}


@query(f"WITH {H}, {NUMBERED_SQL}, a AS (SELECT *, CASE WHEN rn >= 5 THEN avg(close) OVER ({P} ROWS 4 PRECEDING) END AS fast, CASE WHEN rn >= 20 THEN avg(close) OVER ({P} ROWS 19 PRECEDING) END AS slow, lag(close, 10) OVER ({P}) AS old FROM numbered) SELECT symbol, epoch(ts)::BIGINT AS t, round(0.6 * coalesce((fast > slow)::INT, 0) + 0.4 * coalesce((close > old)::INT, 0), 6) AS weight FROM a")
def u08_strategy_weights(spark, sf_dir):
    found = strategies.weights_of(ind.numbered(event_bars(spark, sf_dir)), _NESTED)
    return found.select("symbol", t(), F.round("weight", 6).alias("weight"))


@query(f"WITH {H}, {NUMBERED_SQL}, f AS (SELECT *, (high - low) / CASE WHEN close = 0 THEN NULL ELSE close END AS spread FROM numbered), r AS (SELECT *, (rank() OVER (PARTITION BY ts ORDER BY spread) + (count(*) OVER (PARTITION BY ts, spread) - 1) / 2.0) / count(*) OVER (PARTITION BY ts) AS score FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY round(score, 12) DESC, symbol) AS place FROM r) SELECT symbol, epoch(ts)::BIGINT AS t, round(score / sum(score) OVER (PARTITION BY ts), 6) AS proposed FROM p WHERE place <= 3 AND score > 0")
def u05_custom_factor_policy(spark, sf_dir):
    panel = strategy.factor_panel(event_bars(spark, sf_dir), 5, {"spread": lambda b: b.withColumn("spread", F.try_divide(F.col("high") - F.col("low"), F.col("close")))})
    scored = strategy.scored_panel(panel, {"spread": (1, 1.0)})
    return strategies.policies.load({"name": "top_n_score", "config": {"n": 3}})(scored).select("symbol", t(), F.round("proposed", 6).alias("proposed"))


@query(f"WITH {RAW} SELECT symbol, count(*) AS bars, sum(CASE WHEN trim(symbol) = symbol THEN 1 ELSE 0 END)::BIGINT AS kept, round(max(open), 6) AS open FROM raw GROUP BY 1")
def a13_vendor_frames(spark, sf_dir):
    """Vendor rows with other names and more columns, as bars, and those whose symbol is none."""
    frame = raw_bars(spark, sf_dir).withColumnsRenamed({"ts": "event_time", "symbol": "raw_symbol"}).withColumn("venue", F.lit("x"))
    bars = validate.canonical(frame, {"event_time": "ts", "raw_symbol": "symbol"}, extras="drop")
    good, _ = validate.resolved(bars)
    kept = good.groupBy("symbol").agg(F.count("*").alias("kept"))
    whole = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.round(F.max("open"), 6).alias("open"))
    return whole.join(kept, "symbol", "left").select("symbol", "bars", F.coalesce("kept", F.lit(0)).alias("kept"), "open")


@query(f"WITH {H}, {SESSIONS_SQL}, g AS (SELECT symbol, open_ts, first(open ORDER BY ts) AS o, sum(volume) AS v FROM bars JOIN sessions ON ts >= open_ts AND ts < close_ts GROUP BY 1, 2) SELECT symbol, epoch(open_ts)::BIGINT AS t, CASE WHEN v::BIGINT % 3 = 0 THEN 'volume' ELSE 'open' END AS fault FROM g WHERE v::BIGINT % 3 <> 1")
def e22_resample_check(spark, sf_dir):
    """Faults that are put into resampled bars, as an independent calculation finds them."""
    bars, own = event_bars(spark, sf_dir), sessions(spark)
    out = resample.resample_sessions(bars, own, None, 60, "aggregate")
    part = F.col("volume").cast("long") % 3
    out = out.withColumns({"open": F.when(part == 2, F.col("open") + 1).otherwise(F.col("open")), "volume": F.when(part == 0, F.col("volume") + 1).otherwise(F.col("volume"))})
    return resample.check_resampled(bars, out, own, None).select("symbol", t(), "fault")


@query(f"WITH {H}, {SESSIONS_SQL}, o AS (SELECT DISTINCT symbol, ts + INTERVAL 1 HOUR AS ts FROM bars WHERE volume > 1), due AS (SELECT symbol, label, open_ts, close_ts FROM (SELECT DISTINCT symbol FROM bars), sessions), n AS (SELECT d.symbol, d.label, 7 - count(b.ts) AS missing FROM due d LEFT JOIN bars b ON b.symbol = d.symbol AND b.ts >= open_ts AND b.ts < close_ts GROUP BY 1, 2), k AS (SELECT d.symbol, d.label, count(o.ts) AS known FROM due d LEFT JOIN o ON o.symbol = d.symbol AND o.ts >= open_ts AND o.ts < close_ts GROUP BY 1, 2) SELECT symbol, strftime(label, '%Y-%m-%d') AS label, missing, least(known, missing) AS known FROM n JOIN k USING (symbol, label) WHERE missing <> 0")
def d08_known_omissions(spark, sf_dir):
    bars, own = event_bars(spark, sf_dir), sessions(spark)
    omitted = bars.where("volume > 1").select("symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    found = resample.known_omissions(resample.quality_report(bars, own, None, 60), omitted, own, None)
    return found.select("symbol", F.col("label").cast("string").alias("label"), "missing", "known")


@query(f"WITH {_DAYS}, o AS (SELECT label, label::TIMESTAMP - INTERVAL (day(label) % 4 * 6) HOUR AS open_ts FROM days) SELECT strftime(label, '%Y-%m-%d') AS label FROM o WHERE label >= DATE '2024-01-05' AND label < DATE '2024-01-25' AND NOT (open_ts >= TIMESTAMP '2024-01-05' AND open_ts < TIMESTAMP '2024-01-25')")
def k05_out_of_range_opens(spark, sf_dir):
    days = event_days(spark, sf_dir)
    opened = F.timestamp_seconds(F.unix_seconds(F.col("label").cast("timestamp")) - F.dayofmonth("label") % 4 * 21_600)
    return cal.out_of_range_opens(days.withColumn("open_ts", opened), "2024-01-05", "2024-01-25").select(F.col("label").cast("string").alias("label"))


@query(f"WITH {H} SELECT symbol, 'out_of_range' AS code, count(*) AS n FROM bars WHERE ts < TIMESTAMP '2024-01-03' OR ts >= TIMESTAMP '2024-01-28' GROUP BY 1 UNION ALL SELECT symbol, 'unfinished', count(*) FROM bars WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-20' GROUP BY 1")
def d27_preflight_bounds(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    grid = bars.select("ts").distinct().withColumn("end_ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return research.preflight(bars, bars.select("symbol"), grid, "2024-01-20", ("2024-01-03", "2024-01-28"), skip=("no_data", "missing", "unexpected"))


@query(f"WITH {RAW} SELECT CASE WHEN (open IS NULL OR isnan(open)) AND (high IS NULL OR isnan(high)) AND (low IS NULL OR isnan(low)) AND (close IS NULL OR isnan(close)) THEN 'all prices missing' ELSE why END AS reason, count(*) AS n FROM (SELECT symbol, ts, CASE WHEN sequence % 21 = 0 THEN NULL ELSE open END AS open, CASE WHEN sequence % 21 = 0 THEN NULL ELSE high END AS high, CASE WHEN sequence % 21 = 0 THEN NULL ELSE low END AS low, CASE WHEN sequence % 21 = 0 THEN NULL ELSE close END AS close, volume FROM raw), LATERAL (SELECT {WHY} AS why) WHERE why <> '' GROUP BY 1")
def a10_omitted_positions(spark, sf_dir):
    bars = raw_bars(spark, sf_dir).withColumns({c: F.when(F.col("sequence") % 21 != 0, F.col(c)) for c in PRICES})
    return payloads.split_omitted(bars)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {H} SELECT symbol, epoch(ts)::BIGINT AS t, round(close, 6) AS close FROM bars WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'")
def a10_window_clip(spark, sf_dir):
    rows = event_bars(spark, sf_dir).withColumn("day", F.to_date("ts")).groupBy("symbol", "day").agg(F.sort_array(F.collect_list(F.struct("ts", *VALUES))).alias("r"))
    body = F.to_json(F.struct(F.transform("r", lambda x: F.unix_seconds(x["ts"])).alias("timestamp"), *[F.col(f"r.{c}").alias(c) for c in VALUES]))
    bars, _ = payloads.columnar_bars(rows.select("symbol", body.alias("body")), "2024-01-05 06:00:00", "2024-01-12 18:00:00")
    return shown(bars, "close")


@query(f"WITH {H}, x AS (SELECT *, CASE WHEN hour(ts) = 7 THEN 'n/a' END AS text FROM bars WHERE symbol = 'view') SELECT 'VIEW' AS symbol, epoch(ts)::BIGINT AS t, CASE WHEN text IS NULL THEN round(close, 4) END AS close, text IS NOT NULL AS wrong FROM x")
def a14_wide_prices(spark, sf_dir):
    text = event_bars(spark, sf_dir).where("symbol = 'view'").select("ts", *[F.col(c).cast("decimal(20,4)").cast("string").alias(c.title()) for c in VALUES])
    text = text.withColumn("Close", F.when(F.hour("ts") == 7, "n/a").otherwise(F.col("Close")))
    good, bad = payloads.wide_prices(text, "VIEW", "ts", {c.title(): c for c in VALUES})
    both = good.withColumn("wrong", F.lit(False)).union(bad.withColumn("wrong", F.lit(True)))
    return both.select("symbol", t(), F.round("close", 4).alias("close"), "wrong")


@query(f"WITH {EVENTS} SELECT event_id::VARCHAR AS event_id, symbol, event_type, epoch(effective_ts)::BIGINT AS t, share_ratio FROM acts WHERE symbol <> 'RO' AND event_id % 7 <> 0")
def a15_snapshots(spark, sf_dir):
    """Corporate actions from payloads of a symbol and month in an envelope with a checksum; every seventh event's payload has a wrong one."""
    e = events(spark, sf_dir).where("symbol <> 'RO'")
    item = F.struct(F.col("event_id").cast("string").alias("event_id"), "symbol", "event_type", F.date_format("effective_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("effective_ts"), "share_ratio")
    inner = e.groupBy("symbol", F.date_trunc("month", "effective_ts").alias("m"), (F.col("event_id") % 7 == 0).alias("odd")).agg(F.to_json(F.struct(F.collect_list(item).alias("events"))).alias("inner"))
    check = F.when(F.col("odd"), F.lit("0")).otherwise(F.sha2(F.col("inner").cast("binary"), 256))
    found = payloads.snapshots(inner.select(F.to_json(F.struct(F.col("inner").alias("payload"), check.alias("checksum"))).alias("body")))[1]
    return found.select("event_id", "symbol", "event_type", t("effective_ts"), "share_ratio")


@query(f"{_FLAT.replace('<= 120 *', '<= 190 *')}, last AS (SELECT symbol, max(rn) AS rn FROM numbered GROUP BY 1) SELECT f.symbol, start_rn, end_rn FROM flat f JOIN last l ON l.symbol = f.symbol AND l.rn = f.end_rn")
def f06_current_flat(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    found = detect.current_flat(detect.flat_windows(bars, 3, 12, limit=190.0), bars)
    return found.select("symbol", F.col("start_rn").cast("long").alias("start_rn"), F.col("end_rn").cast("long").alias("end_rn"))


@query(f"WITH {RAW}, bad AS (SELECT *, {WHY} AS why FROM raw WHERE {WHY} <> ''), k AS (SELECT symbol, ts, sequence, row_number() OVER (ORDER BY symbol, ts, sequence) AS place, count(*) OVER () AS n FROM bad) SELECT symbol, epoch(ts)::BIGINT AS t, n - 10 AS more FROM k WHERE place <= 10")
def g04_first_offenders(spark, sf_dir):
    return validate.first_offenders(raw_bars(spark, sf_dir)).select("symbol", t(), "more")


@query(f"WITH {H}, a AS (SELECT symbol, ts, close, 'before' AS side FROM bars ORDER BY symbol, ts LIMIT 100), b AS (SELECT symbol, ts, close * 2 AS close, 'after' AS side FROM bars WHERE hour(ts) >= 12 ORDER BY symbol, ts LIMIT 100) SELECT side, symbol, epoch(ts)::BIGINT AS t, round(close, 6) AS close FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def g06_preview(spark, sf_dir):
    recipe = registry.load('[{"name": "scale_prices", "config": {"factor": 2.0}}, {"name": "clock_window", "config": {"start": "12:00", "end": "00:00"}}]')
    before, after = preview(recipe, event_bars(spark, sf_dir), Contract("1h"))
    return before.withColumn("side", F.lit("before")).union(after.withColumn("side", F.lit("after"))).select("side", "symbol", t(), F.round("close", 6).alias("close"))


@query(f"WITH {H}, ask AS (SELECT DISTINCT symbol FROM bars UNION ALL SELECT 'nothing') SELECT ask.symbol, count(b.ts) AS bars_in, count(b.ts) FILTER (hour(b.ts) >= 22) AS bars_out, CASE WHEN count(b.ts) = 0 THEN 'no data' WHEN count(b.ts) FILTER (hour(b.ts) >= 22) = 0 THEN 'empty' ELSE 'done' END AS status FROM ask LEFT JOIN bars b ON b.symbol = ask.symbol GROUP BY 1")
def u04_status_by_ticker(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    asked = bars.select("symbol").union(bars.select(F.lit("nothing"))).distinct()
    recipe = registry.load('[{"name": "clock_window", "config": {"start": "22:00", "end": "00:00"}}]')
    return by_ticker(recipe, bars, Contract("1h"), asked)[1]
