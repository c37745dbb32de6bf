"""Queries on reports, trades, positions and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions import indicators as ind
from barspark.operators import actions, money, research, strategy, support
from barspark.operators import sessions as cal
from barspark.queries import NUMBERED_SQL, SESSIONS_SQL, event_bars_sql, query, sessions, ship_bars_sql
from barspark.queries.tables import EVENTS, events
from barspark.sources.bars import event_bars, read, ship_bars

H = event_bars_sql("hour")
S = ship_bars_sql()
P = "PARTITION BY symbol ORDER BY ts"
#: Hours between a symbol's first and last bar that have none, and hours of a single event, which have been repaired.
OMITTED = "omitted AS (SELECT symbol, ts FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR))::TIMESTAMP AS ts FROM bars GROUP BY symbol) WHERE (symbol, ts) NOT IN (SELECT (symbol, ts) FROM bars) UNION ALL SELECT symbol, ts FROM bars WHERE volume = 1)"


def t(c="ts", name="t"):
    return F.unix_seconds(c).alias(name)


def omitted(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    hours = bars.groupBy("symbol").agg(F.explode(F.sequence(F.min("ts"), F.max("ts"), F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    return hours.join(bars, ["symbol", "ts"], "left_anti").union(bars.where("volume = 1").select("symbol", "ts"))


@query(f"WITH {H}, {SESSIONS_SQL}, i AS (SELECT * FROM bars JOIN (SELECT label, open_ts - INTERVAL 30 MINUTE AS open_ts, close_ts FROM sessions) ON ts >= open_ts AND ts < close_ts) SELECT symbol, epoch(ts)::BIGINT AS t, coalesce(round(max(CASE WHEN ts = open_ts THEN open END) OVER (PARTITION BY symbol, label), 6), -1) AS reference FROM i")
def c11_session_open(spark, sf_dir):
    early = sessions(spark).withColumn("open_ts", F.col("open_ts") - F.expr("INTERVAL 30 MINUTES"))
    found = research.session_open_prices(event_bars(spark, sf_dir), early)
    return found.select("symbol", t(), F.coalesce(F.round("reference", 6), F.lit(-1.0)).alias("reference"))


@query(f"WITH {H}, {SESSIONS_SQL}, early AS (SELECT label, open_ts - INTERVAL 30 MINUTE AS open_ts, close_ts FROM sessions), stacked AS (SELECT symbol, ts, open, true AS picked FROM bars WHERE close >= open UNION ALL SELECT symbol, ts, 2 * open, false FROM bars WHERE volume >= 2), i AS (SELECT * FROM stacked JOIN early ON ts >= open_ts AND ts < close_ts) SELECT symbol, epoch(ts)::BIGINT AS t, picked, coalesce(round(coalesce(max(CASE WHEN ts = open_ts AND picked THEN open END) OVER w, max(CASE WHEN ts = open_ts THEN open END) OVER w), 6), -1) AS reference FROM i WINDOW w AS (PARTITION BY symbol, label)")
def c11_selected_over_support(spark, sf_dir):
    """Both tables may have the bar at the opening: the selected one counts."""
    bars = event_bars(spark, sf_dir)
    stacked = support.stacked(bars.where("volume >= 2").withColumns({"open": 2 * F.col("open"), "picked": F.lit(False)}), bars.where("close >= open").withColumn("picked", F.lit(True)))
    early = sessions(spark).withColumn("open_ts", F.col("open_ts") - F.expr("INTERVAL 30 MINUTES"))
    return research.session_open_prices(stacked, early, "picked").select("symbol", t(), "picked", F.coalesce(F.round("reference", 6), F.lit(-1.0)).alias("reference"))


@query(f"WITH {H}, {OMITTED} SELECT o.symbol, epoch(o.ts)::BIGINT AS t, b.ts IS NOT NULL AS present FROM omitted o LEFT JOIN bars b ON b.symbol = o.symbol AND b.ts = o.ts")
def c13_omission_states(spark, sf_dir):
    return research.omission_states(omitted(spark, sf_dir), event_bars(spark, sf_dir)).select("symbol", t(), "present")


_SEGMENTS = f"{H}, {OMITTED}, numbered AS (SELECT b.*, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) AS rn, (SELECT count(*) FROM omitted o WHERE o.symbol = b.symbol AND o.ts < b.ts AND (o.symbol, o.ts) NOT IN (SELECT (symbol, ts) FROM bars)) AS segment FROM bars b)"


@query(f"WITH {_SEGMENTS} SELECT symbol, epoch(ts)::BIGINT AS t, segment FROM numbered")
def f09_omission_segments(spark, sf_dir):
    return research.omission_segments(event_bars(spark, sf_dir), omitted(spark, sf_dir)).select("symbol", t(), "segment")


@query(f"""WITH {_SEGMENTS}, cand AS (SELECT e.symbol, e.rn AS end_rn, s.rn AS start_rn, max(b.high) AS hi, min(b.low) AS lo FROM numbered e JOIN numbered s ON s.symbol = e.symbol AND s.segment = e.segment AND s.rn BETWEEN e.rn - 11 AND e.rn - 2 JOIN numbered b ON b.symbol = e.symbol AND b.rn BETWEEN s.rn AND e.rn GROUP BY 1, 2, 3)
SELECT symbol, min(start_rn) AS start_rn, end_rn FROM cand WHERE 200 * (hi - lo) / (hi + lo) <= 120 * (1 + 1e-12) GROUP BY symbol, end_rn""")
def f09_flats_by_segment(spark, sf_dir):
    """Flat stretches, none of which spans a bar that is missing."""
    from barspark.operators import detect

    bars = research.omission_segments(event_bars(spark, sf_dir), omitted(spark, sf_dir))
    found = detect.flat_windows(bars, 3, 12, limit=120.0, keys=("symbol", "segment"))
    return found.select("symbol", F.col("start_rn").cast("long").alias("start_rn"), F.col("end_rn").cast("long").alias("end_rn"))


@query(f"WITH {H}, {OMITTED}, n AS (SELECT *, row_number() OVER ({P}) AS n FROM omitted) SELECT symbol, count(*) AS omitted, string_agg(strftime(ts, '%Y-%m-%d %H:%M'), ', ' ORDER BY ts) FILTER (n <= 5) AS preview FROM n GROUP BY symbol")
def d26_omission_preview(spark, sf_dir):
    return research.omission_preview(omitted(spark, sf_dir))


@query(f"WITH {H}, d AS (SELECT DISTINCT symbol, ts::DATE::TIMESTAMP AS o FROM bars), due AS (SELECT symbol, o, o + INTERVAL (h) HOUR AS ts FROM d, range(24) r(h)) SELECT symbol, epoch(o)::BIGINT AS o, epoch(ts)::BIGINT AS t FROM due WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = due.symbol AND b.ts = due.ts)")
def c15_uncovered_sources(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    days = bars.select("symbol", F.date_trunc("day", "ts").alias("ts")).distinct().withColumn("end_ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    return research.uncovered_sources(days, bars, 3600).select("symbol", t("output_ts", "o"), t())


@query(f"""WITH {H}, {SESSIONS_SQL}, g AS (SELECT DISTINCT date_trunc('hour', open_ts + INTERVAL (h) HOUR) AS ts FROM sessions, range(7) r(h)), due AS (SELECT symbol, ts FROM (SELECT DISTINCT symbol FROM bars), g), ask AS (SELECT * FROM (VALUES ('view'), ('nothing')) a(symbol))
SELECT symbol, 'no_data' AS code, 1 AS n FROM ask WHERE symbol NOT IN (SELECT symbol FROM bars) UNION ALL SELECT symbol, 'missing', count(*) FROM (SELECT * FROM due EXCEPT SELECT symbol, ts FROM bars) GROUP BY 1 UNION ALL SELECT symbol, 'unexpected', count(*) FROM bars WHERE ts NOT IN (SELECT ts FROM g) GROUP BY 1
UNION ALL SELECT symbol, 'unfinished', count(*) FROM bars WHERE ts IN (SELECT ts FROM g WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-20') GROUP BY 1""")
def d27_preflight(spark, sf_dir):
    grid = cal.expected_grid(sessions(spark), 60).select(F.date_trunc("hour", "ts").alias("ts")).distinct().withColumn("end_ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    bars = event_bars(spark, sf_dir)
    asked = bars.select(F.lit("view").alias("symbol")).union(bars.select(F.lit("nothing"))).distinct()
    return research.preflight(bars, asked, grid, "2024-01-20")


@query(f"WITH {H}, {NUMBERED_SQL} SELECT symbol, epoch(min(ts))::BIGINT AS listed, epoch(min(ts) FILTER (rn = 21))::BIGINT AS effective FROM numbered GROUP BY symbol")
def d28_effective_starts(spark, sf_dir):
    return research.effective_starts(event_bars(spark, sf_dir), 20).select("symbol", t("listed", "listed"), t("effective_start", "effective"))


TRADES = f"""entries AS (SELECT symbol, rn, lead(open) OVER ({P}) AS entry, lead(close, 5) OVER ({P}) AS exit, CASE WHEN rn % 2 = 0 THEN 'short' ELSE 'long' END AS direction FROM numbered), trades AS (
  SELECT *, CASE WHEN direction = 'short' THEN -1 ELSE 1 END * (exit - entry) * 3 AS gross, (entry + exit) * 3 * 0.0005 AS fees FROM entries WHERE exit IS NOT NULL)"""


def trades(spark, sf_dir):
    w = ind.by_time()
    df = ind.numbered(event_bars(spark, sf_dir)).withColumns({"entry": F.lead("open").over(w), "exit": F.lead("close", 5).over(w), "quantity": F.lit(3.0), "direction": F.when(F.col("rn") % 2 == 0, "short").otherwise("long")})
    return research.trade_results(df.where("exit is not null"), 5.0)


@query(f"WITH {H}, {NUMBERED_SQL}, {TRADES} SELECT symbol, rn, round(gross, 6) AS gross, round(fees, 6) AS fees, round(gross - fees, 6) AS net FROM trades")
def j16_trade_results(spark, sf_dir):
    return trades(spark, sf_dir).select("symbol", F.col("rn").cast("long").alias("rn"), *[F.round(c, 6).alias(c) for c in ("gross", "fees", "net")])


@query(f"WITH {H}, {NUMBERED_SQL}, {TRADES} SELECT symbol, direction, count(*) FILTER (exit > entry AND rn % 5 <> 0) AS wins, count(*) FILTER (exit < entry AND rn % 5 <> 0) AS losses, count(*) FILTER (exit = entry AND rn % 5 <> 0) AS inconclusive, round(sum(gross - fees) FILTER (rn % 5 <> 0), 5) AS realised, round(sum(gross - fees) FILTER (rn % 5 = 0), 5) AS unrealised FROM trades GROUP BY 1, 2")
def d19_outcome_summary(spark, sf_dir):
    outcome = F.when(F.col("rn") % 5 == 0, "open").when(F.col("exit") > F.col("entry"), "win").when(F.col("exit") < F.col("entry"), "loss").otherwise("inconclusive")
    found = research.outcome_summary(trades(spark, sf_dir).withColumn("outcome", outcome), "symbol")
    return found.select("symbol", "direction", "wins", "losses", "inconclusive", F.round("realised", 5).alias("realised"), F.round("unrealised", 5).alias("unrealised"))


@query(f"""WITH RECURSIVE {H}, {NUMBERED_SQL}, e AS (SELECT symbol, rn AS start_rn, rn + 3 + rn % 11 AS end_rn FROM numbered WHERE close > open), picked AS (
  SELECT symbol, min(start_rn) AS start_rn, arg_min(end_rn, start_rn) AS end_rn FROM e GROUP BY symbol UNION ALL SELECT p.symbol, n.start_rn, n.end_rn FROM picked p, LATERAL (SELECT start_rn, end_rn FROM e WHERE e.symbol = p.symbol AND e.start_rn > p.end_rn ORDER BY start_rn LIMIT 1) n)
SELECT symbol, start_rn, end_rn FROM picked""")
def j15_held_once(spark, sf_dir):
    e = ind.numbered(event_bars(spark, sf_dir)).where("close > open").select("symbol", F.col("rn").cast("long").alias("start_rn"), (F.col("rn") + 3 + F.col("rn") % 11).cast("long").alias("end_rn"))
    return research.held_once(e)


@query("WITH a AS (SELECT o_orderpriority AS strategy, o_custkey AS ticker, 50 + o_custkey % 100 AS growth FROM orders GROUP BY 1, 2, 3), p AS (SELECT *, 1000000000000::HUGEINT // count(*) OVER (PARTITION BY strategy) AS part FROM a) SELECT strategy, sum(part * growth)::VARCHAR AS invested_units, (1000000000000 - sum(part))::VARCHAR AS idle_units, count(*) AS accounts FROM p GROUP BY 1")
def d20_split_capital(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("strategy"), F.col("o_custkey").alias("ticker"), (0.5 + (F.col("o_custkey") % 100) / 100.0).alias("growth")).distinct()
    found = money.split_capital(o, 10000)
    units = lambda c, n: (F.col(c) * n).cast("decimal(34, 0)").cast("string")
    return found.select("strategy", units("invested", 10_000_000_000).alias("invested_units"), units("idle", 100_000_000).alias("idle_units"), "accounts")


@query(f"WITH {S}, v AS (SELECT symbol, ts, close * ascii(symbol[1]) AS value FROM bars) SELECT symbol, epoch(ts)::BIGINT AS t, round(ln(value), 6) AS value, round(value / (sum(value) OVER (PARTITION BY ts) + 500), 6) AS weight FROM v")
def j18_marks(spark, sf_dir):
    bars = ship_bars(spark, sf_dir)
    held = bars.select("symbol", F.ascii("symbol").cast("double").alias("quantity")).distinct()
    return research.marks(held, bars, 500.0).select("symbol", t(), F.round(F.log("value"), 6).alias("value"), F.round("weight", 6).alias("weight"))


@query(f"WITH {H} SELECT symbol, epoch(ts)::BIGINT AS t FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM bars) WHERE n <= 50")
def g07_last_rows(spark, sf_dir):
    return research.last_rows_of(event_bars(spark, sf_dir), 50).select("symbol", t())


@query("SELECT c_custkey % 1000 AS place, c_custkey AS ticker, round(max(o_totalprice), 2) AS value, count(*) AS rows_found FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def g08_screening(spark, sf_dir):
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), (F.col("c_custkey") % 1000).alias("place"))
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ticker")).agg(F.max("o_totalprice").alias("value"), F.count("*").alias("rows_found"))
    return research.screening(rows, asked).withColumn("value", F.round("value", 2))


@query(f"WITH {S}, a AS (SELECT symbol, ts, CASE WHEN symbol = 'AF' THEN NULL ELSE close END AS score, 0.25 AS current, close AS target FROM bars), b AS (SELECT *, greatest(0, 1 - 0.1 - coalesce(sum(CASE WHEN score IS NULL THEN current END) OVER (PARTITION BY ts), 0)) AS remaining, sum(CASE WHEN score IS NOT NULL THEN target END) OVER (PARTITION BY ts) AS total FROM a) SELECT symbol, epoch(ts)::BIGINT AS t, round(CASE WHEN score IS NULL THEN current ELSE target / total * remaining END, 6) AS planned FROM b")
def j06_frozen_holdings(spark, sf_dir):
    bars = ship_bars(spark, sf_dir).withColumns({"score": F.when(F.col("symbol") != "AF", F.col("close")), "current": F.lit(0.25), "target": F.col("close")})
    return strategy.with_frozen(bars, 0.1).select("symbol", t(), F.round("planned", 6).alias("planned"))


@query(f"WITH {H}, o AS (SELECT *, floor(0.9 * 1000 / open) AS wanted, open * 1.0002 AS price FROM bars), f AS (SELECT *, list_max(list_filter([greatest(floor((700 - 1) / (price * 1.0005)) - i, 0) FOR i IN range(5)], lambda q: q * price + ceil((1 + q * price * 0.0005) * 1e8) / 1e8 <= 700)) AS afford FROM o) SELECT symbol, epoch(ts)::BIGINT AS t, wanted::BIGINT AS wanted, (CASE WHEN wanted > 0 THEN least(wanted, coalesce(afford, 0)) ELSE wanted END)::BIGINT AS filled FROM f")
def j11_order_sizes(spark, sf_dir):
    bars = event_bars(spark, sf_dir).withColumns({"weight": F.lit(0.9), "equity": F.lit(1000.0), "cash": F.lit(700.0), "held": F.lit(0)})
    return strategy.order_sizes(bars, 1.0, 5.0, 2.0).select("symbol", t(), "wanted", "filled")


@query("""WITH {H}, o AS (SELECT symbol, ts, round(open, 2)::DECIMAL(14, 2) AS o, ((row_number() OVER (PARTITION BY symbol ORDER BY ts)) % 9)::HUGEINT AS held FROM bars), p AS (SELECT *, (o * 100)::HUGEINT * 1000000 AS o8 FROM o), w AS (
  SELECT *, 6000000000::HUGEINT + held * o8 AS equity8, ((6000000000::HUGEINT + held * o8) * 8 // 10) // o8 AS desired FROM p), d AS (SELECT *, desired - held AS wanted, (o * 100)::HUGEINT * (CASE WHEN desired > held THEN 1000200 ELSE 999800 END) AS p8 FROM w), c AS (
  SELECT *, unnest([least(wanted, (5990000000::HUGEINT * 10000 // (p8 * 10005)) + k) FOR k IN range(-3, 4)]) AS q FROM d), f AS (
  SELECT *, CASE WHEN wanted > 0 THEN coalesce(pays, 0) ELSE wanted END AS filled FROM (SELECT symbol, ts, wanted, p8, held, max(q) FILTER (q >= 0 AND q * p8 + 10000000 + (q * p8 * 5 + 9999) // 10000 <= 6000000000) AS pays FROM c GROUP BY symbol, ts, wanted, p8, held))
SELECT symbol, epoch(ts)::BIGINT AS t, wanted::BIGINT AS wanted, filled::BIGINT AS filled, (CASE WHEN filled = 0 THEN 0 ELSE 10000000 + (abs(filled) * p8 * 5 + 9999) // 10000 END)::VARCHAR AS fee_units, (held + filled)::BIGINT AS held_after,
  (6000000000 - filled * p8 - CASE WHEN filled = 0 THEN 0 ELSE 10000000 + (abs(filled) * p8 * 5 + 9999) // 10000 END)::VARCHAR AS cash_units, CASE WHEN wanted = 0 THEN 'none' WHEN filled = 0 THEN 'rejected' WHEN filled = wanted THEN 'filled' ELSE 'reduced' END AS status FROM f""".replace("{H}", H))
def j11_exact_orders(spark, sf_dir):
    """Whole shares to 0.8 of equity with 60 in cash, to the last of eight places."""
    place = F.row_number().over(ind.by_time())
    bars = event_bars(spark, sf_dir).select("symbol", "ts", F.round("open", 2).alias("open"), F.lit(0.8).alias("weight"), F.lit(60).alias("cash"), (place % 9).alias("held"))
    found = money.order_sizes(bars, 0.1, 5.0, 2.0)
    units = lambda c: (F.col(c) * 100_000_000).cast("decimal(30, 0)").cast("string")
    return found.select("symbol", t(), F.col("wanted").cast("long").alias("wanted"), F.col("filled").cast("long").alias("filled"), units("fee").alias("fee_units"), F.col("held_after").cast("long").alias("held_after"), units("cash_after").alias("cash_units"), "status")


@query(f"WITH {EVENTS}, k AS (SELECT unnest(['AF', 'NF', 'NO', 'RF', 'ZZ']) AS symbol) SELECT k.symbol, coalesce(event_type, CASE WHEN k.symbol IN ('NF', 'ZZ') THEN 'none' ELSE 'coverage unknown' END) AS report FROM k LEFT JOIN acts a ON a.symbol = k.symbol AND event_type = 'merger'")
def i08_other_events(spark, sf_dir):
    e = events(spark, sf_dir)
    names = e.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ["AF", "NF", "NO", "RF", "ZZ"]))).alias("symbol"))
    coverage = names.select("symbol", F.when(F.col("symbol").isin("NF", "ZZ"), "complete").otherwise("unknown").alias("other_events_status"))
    return actions.other_events(names, coverage, e)


_COVER = "spans AS (SELECT o_custkey AS symbol, min(o_orderdate)::DATE AS f, max(o_orderdate)::DATE AS l FROM orders GROUP BY 1), cover AS (SELECT o_custkey AS symbol, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'partial' ELSE 'complete' END AS status FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey, o_orderstatus = 'F')"


@query(f"WITH {_COVER} SELECT symbol, CASE WHEN count(status) = 0 THEN 'no coverage' WHEN count(status) > 1 THEN 'several coverage rows' WHEN count(*) FILTER (status = 'complete' AND s <= f AND e >= l) = 0 THEN 'does not cover the bars' ELSE 'good' END AS fault FROM spans LEFT JOIN cover USING (symbol) GROUP BY symbol")
def i06_coverage_faults(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_totalprice")
    spans = o.groupBy("symbol").agg(F.min("day").alias("first_date"), F.max("day").alias("last_date"))
    kept = o.where("o_totalprice > 100000").groupBy("symbol", F.col("o_orderstatus") == "F").agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"), F.bool_or(F.col("o_orderstatus") == "P").alias("some"))
    coverage = kept.select("symbol", "start_date", "end_date", F.when(F.col("some"), "partial").otherwise("complete").alias("status"), F.lit("unadjusted").alias("source_basis"))
    return actions.coverage_faults(coverage, spans).select("symbol", F.coalesce("fault", F.lit("good")).alias("fault"))


@query("""WITH o AS (SELECT o_custkey AS symbol, o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS id, o_orderdate::DATE AS d, o_orderpriority AS kind, o_totalprice > 150000 AS terms, o_orderstatus = 'P' AS open FROM orders), s AS (SELECT symbol, min(d) AS f, max(d) AS l FROM o GROUP BY 1), cover AS (SELECT symbol, id, min(d) AS a, max(d) AS b FROM o GROUP BY 1, 2), faults AS (
  SELECT symbol, 'other security' AS fault FROM cover JOIN s USING (symbol) WHERE id <> symbol AND b >= f AND a <= l UNION SELECT symbol, 'other security' FROM o WHERE id <> symbol UNION SELECT symbol, 'unresolved event' FROM o WHERE open UNION SELECT symbol, 'duplicate terms' FROM o GROUP BY symbol, d, kind, terms HAVING count(*) > 1)
SELECT s.symbol, coalesce(string_agg(fault, ', ' ORDER BY fault), '') AS faults FROM s LEFT JOIN faults USING (symbol) GROUP BY s.symbol""")
def i06_identity_faults(spark, sf_dir):
    """Orders as events: one in fifty is of another security, open ones are unresolved."""
    o = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("symbol"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0)).alias("security_id"), F.to_date("o_orderdate").alias("effective_date"), F.col("o_orderpriority").alias("event_type"),
        (F.col("o_totalprice") > 150000).alias("terms"), F.when(F.col("o_orderstatus") == "P", "unresolved").otherwise("resolved").alias("status"),
    )
    ends = [F.min("effective_date"), F.max("effective_date")]
    spans = o.groupBy("symbol").agg(F.first("symbol").alias("security_id"), ends[0].alias("first_date"), ends[1].alias("last_date"))
    coverage = o.groupBy("symbol", "security_id").agg(ends[0].alias("start_date"), ends[1].alias("end_date"))
    return actions.identity_faults(spans, coverage, o).select("symbol", F.array_join("faults", ", ").alias("faults"))


@query("""WITH a AS (SELECT o_custkey AS symbol, o_orderdate::DATE AS date, max(o_totalprice) AS amount FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2), b AS (SELECT o_custkey AS symbol, o_orderdate::DATE AS date, max(o_totalprice) + o_custkey % 2 AS amount FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2)
SELECT CASE WHEN a.symbol IS NULL THEN 'right only' WHEN b.symbol IS NULL THEN 'left only' WHEN abs(a.amount - b.amount) <= greatest(1e-6, 1e-5 * greatest(abs(a.amount), abs(b.amount))) THEN 'agree' ELSE 'differ' END AS state, count(*) AS n FROM a FULL JOIN b ON a.symbol = b.symbol AND a.date = b.date GROUP BY 1""")
def i12_dividend_agreement(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice")
    one = lambda n: o.where(f"o_orderkey % {n} <> 0").groupBy("symbol", "date").agg(F.max("o_totalprice").alias("amount"))
    right = one(4).withColumn("amount", F.col("amount") + F.col("symbol") % 2)
    return actions.agreement(one(3), right, relative=1e-5).groupBy("state").agg(F.count("*").alias("n"))


W = ship_bars_sql("week", True)


@query(f"WITH {H}, {SESSIONS_SQL}, g AS (SELECT o + INTERVAL (h) HOUR AS ts FROM (SELECT open_ts AS o FROM sessions), range(7) r(h)), sup AS (SELECT * FROM g WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC LIMIT 10) SELECT epoch(ts)::BIGINT AS t, true AS is_support FROM sup UNION ALL SELECT epoch(ts)::BIGINT, false FROM g WHERE ts >= TIMESTAMP '2024-01-15' AND ts < (SELECT max(ts) FROM bars)")
def k01_grid_with_lookback(spark, sf_dir):
    grid = cal.expected_grid(sessions(spark), 60)
    end = event_bars(spark, sf_dir).agg(F.max("ts").alias("end"))
    found = cal.grid_with_lookback(grid, "2024-01-15", "2025-01-01", 10).crossJoin(F.broadcast(end))  # one row
    return found.where("is_support or ts < end").select(t(), "is_support")


_SPANS = "periods AS (SELECT symbol, ts - INTERVAL 20 DAY AS start_ts, ts AS end_ts FROM bars)"


_MONTH = f"""{S}, {_SPANS}, r AS (SELECT *, close / lag(close) OVER ({P}) - 1 AS ret FROM bars), l AS (SELECT symbol, max(ts) - INTERVAL 1 MONTH AS since FROM bars GROUP BY 1), c AS (SELECT DISTINCT p.symbol, greatest(start_ts, since) AS s, end_ts AS e FROM periods p JOIN l USING (symbol) WHERE end_ts >= since), k AS (
  SELECT c.symbol, c.s, c.e, r.*, row_number() OVER (PARTITION BY c.symbol, c.s, c.e ORDER BY ts) AS place FROM c JOIN r ON r.symbol = c.symbol WHERE r.ts BETWEEN c.s AND c.e)"""


def _month(spark, sf_dir):
    bars = ship_bars(spark, sf_dir)
    periods = bars.select("symbol", (F.col("ts") - F.expr("INTERVAL 20 DAYS")).alias("start_ts"), F.col("ts").alias("end_ts"))
    return research.last_month(periods, bars), bars


@query(f"WITH {_MONTH} SELECT symbol, epoch(s)::BIGINT AS s, epoch(e)::BIGINT AS e, count(*) AS bars, count(*) FILTER (close < open) AS red, round(avg(close), 6) AS mean, round(100 * stddev_pop(ret) FILTER (place > 1), 5) AS volatility FROM k GROUP BY symbol, s, e")
def d17_last_month(spark, sf_dir):
    found = research.period_means(*_month(spark, sf_dir))
    return found.select("symbol", t("start_ts", "s"), t("end_ts", "e"), "bars", "red", F.round("mean", 6).alias("mean"), F.round("volatility", 5).alias("volatility"))


@query(f"""WITH {_MONTH} SELECT symbol, count(DISTINCT (s, e)) AS periods, count(*) AS bars, count(*) FILTER (close < open) AS red, count(*) FILTER (high > open * 1.02) AS above, round(count(*) FILTER (close < open AND high > open * 1.02) / nullif(count(*) FILTER (close < open), 0), 6) AS red_above_share,
  count(ret) FILTER (place > 1) AS returns, round(100 * stddev_pop(ret) FILTER (place > 1), 5) AS volatility FROM k GROUP BY symbol""")
def d17_month_summary(spark, sf_dir):
    """The clipped periods of the last month, pooled."""
    from barspark.operators import detect

    periods, bars = _month(spark, sf_dir)
    found = detect.pooled_statistics(detect.flat_statistics(periods, bars, 1.02, by="ts"))
    return found.select("symbol", "periods", "bars", "red", "above", F.round("red_above_share", 6).alias("red_above_share"), "returns", F.round("volatility", 5).alias("volatility"))


@query(f"WITH {S} SELECT symbol, epoch(ts)::BIGINT AS t, round(ln(1 + volume * least(1, 75 / sum(volume) OVER (PARTITION BY ts))), 6) AS pro_rata, round(greatest(0, least(volume, 75 - coalesce(sum(volume) OVER (PARTITION BY ts ORDER BY close DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))), 6) AS by_priority FROM bars")
def j12_joint_funding(spark, sf_dir):
    orders = ship_bars(spark, sf_dir).select("ts", "symbol", F.col("volume").alias("cost"), F.col("close").alias("score"))
    both = research.joint_funding(research.joint_funding(orders, 100.0, reserve=25.0).withColumnRenamed("funded", "part"), 100.0, True, reserve=25.0)
    return both.select("symbol", t(), F.round(F.log1p("part"), 6).alias("pro_rata"), F.round("funded", 6).alias("by_priority"))


@query(f"WITH {S} SELECT symbol, epoch(ts)::BIGINT AS t, round(floor(1000.0 / count(*) OVER (PARTITION BY ts) * 1e8) / 1e8, 6) AS even, round(floor(volume / 3 * 1e8) / 1e8, 6) AS slot, round(floor(volume * 7.5 / 100 * 1e8) / 1e8, 6) AS percent FROM bars")
def j19_free_cash(spark, sf_dir):
    bars = ship_bars(spark, sf_dir)
    for name, cash, how in (("even", F.lit(1000.0), {}), ("slot", F.col("volume"), {"slots": 3}), ("percent", F.col("volume"), {"percent": 7.5})):
        bars = research.free_cash_budgets(bars, cash, **how).withColumnRenamed("budget", name)
    return bars.select("symbol", t(), *[F.round(c, 6).alias(c) for c in ("even", "slot", "percent")])


@query(f"""WITH {SESSIONS_SQL} SELECT strftime(label, '%Y-%m-%d') AS label, epoch(timezone('America/New_York', label::TIMESTAMP + INTERVAL 4 HOUR))::BIGINT AS o, epoch(timezone('America/New_York', label::TIMESTAMP + CASE WHEN strftime(timezone('America/New_York', timezone('UTC', close_ts)), '%H:%M') < '16:00' THEN INTERVAL 17 HOUR ELSE INTERVAL 20 HOUR END))::BIGINT AS c
FROM sessions WHERE label IN (SELECT ts::DATE FROM events)""")
def e30_extended_sessions(spark, sf_dir):
    days = read(spark, sf_dir, "events").select(F.to_date("ts").alias("label")).distinct()
    found = cal.extended_bounds(sessions(spark).join(days, "label", "left_semi"))
    return found.select(F.col("label").cast("string").alias("label"), t("long_open", "o"), t("long_close", "c"))


@query(f"WITH {H}, {NUMBERED_SQL}, f AS (SELECT symbol, min(ts) FILTER (volume > 3) AS start FROM bars GROUP BY 1) SELECT symbol, epoch(ts)::BIGINT AS t FROM numbered JOIN f USING (symbol) WHERE rn >= 30 AND (start IS NULL OR ts >= start)")
def e28_eligible(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    starts = bars.groupBy("symbol").agg(F.min(F.when(F.col("volume") > 3, F.col("ts"))).alias("effective_start"))
    return strategy.eligible(bars, 30, starts).select("symbol", t())


@query(f"WITH {H}, o AS (SELECT *, floor(0.9 * 1000 / open) - 5 AS wanted, CASE WHEN floor(volume)::BIGINT % 2 = 0 THEN 0 ELSE volume END AS traded FROM bars), p AS (SELECT *, open * (1 + sign(wanted) * 0.0002) AS price FROM o), f AS (SELECT *, coalesce(list_max(list_filter([greatest(floor((700 - 1) / (price * 1.0005)) - i, 0) FOR i IN range(5)], lambda q: q * price + ceil((1 + q * price * 0.0005) * 1e8) / 1e8 <= 700)), 0) AS afford FROM p), g AS (SELECT *, CASE WHEN traded = 0 THEN 0 WHEN wanted > 0 THEN least(wanted, afford) ELSE wanted END AS filled FROM f) SELECT symbol, epoch(ts)::BIGINT AS t, filled::BIGINT AS filled, CASE WHEN traded = 0 AND wanted <> 0 THEN 'rejected' WHEN filled = wanted THEN 'filled' WHEN filled = 0 THEN 'rejected' ELSE 'reduced' END AS status, round(CASE WHEN filled = 0 THEN 0 ELSE ceil((1 + abs(filled) * price * 0.0005) * 1e8) / 1e8 END, 6) AS fee FROM g")
def j13_order_status(spark, sf_dir):
    bars = event_bars(spark, sf_dir).withColumns({"weight": F.lit(0.9), "equity": F.lit(1000.0), "cash": F.lit(700.0), "held": F.lit(5), "volume": F.when(F.floor("volume") % 2 == 0, 0.0).otherwise(F.col("volume"))})
    return strategy.order_sizes(bars, 1.0, 5.0, 2.0).select("symbol", t(), "filled", "status", F.round("fee", 6).alias("fee"))


@query("SELECT o_custkey AS key, o_orderpriority AS source, min(o_totalprice > 150000)::INT AS value, count(DISTINCT o_totalprice > 150000) > 1 AS conflict FROM orders GROUP BY 1, 2")
def d14_merged_summaries(spark, sf_dir):
    from barspark.operators import rollup

    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("source"), (F.col("o_totalprice") > 150000).cast("int").alias("v"))
    return rollup.merged_summaries(o, "key", "source", "v")


@query()
def f16_redundant_intervals(spark, sf_dir):
    from barspark.operators import detect

    accepted = detect.trend_gates(detect.trend_evidence(event_bars(spark, sf_dir), (8, 16)), clarity=0.3, boundary=0.0).where("accepted")
    spans = accepted.select("symbol", (F.col("rn") - F.col("lookback") + 1).alias("start_rn"), F.col("rn").alias("end_rn"), "direction", F.round("clarity", 9).alias("clarity"))
    return research.suppress_redundant(spans)
