"""Queries on intervals, revisions, corporate actions, roll-ups and detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.operators import actions, detect, intervals, rollup
from barspark.queries import NUMBERED_SQL, event_bars_sql, query, ship_bars_sql
from barspark.sources.bars import event_bars, read, ship_bars

H = event_bars_sql("hour")
S = ship_bars_sql()


def spans(spark, sf_dir):
    """Spans of days by customer, from its orders: each order covers some days from its date."""
    o = read(spark, sf_dir, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return o.select(F.col("o_custkey").alias("key"), day.alias("start"), (day + 1 + F.col("o_orderkey") % 120).alias("end"))


SPANS = "spans AS (SELECT o_custkey AS key, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS start, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 1 + o_orderkey % 120 AS \"end\" FROM orders)"


def islands_sql(source: str, op: str, name: str = "islands") -> str:
    return f"""{name} AS (SELECT *, sum(CASE WHEN reach IS NULL OR start {op} reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, max("end") OVER (PARTITION BY key ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}))"""


@query(f'WITH {SPANS}, {islands_sql("spans", ">")} SELECT key, min(start) AS start, max("end") AS "end", count(*) AS parts FROM islands GROUP BY key, island')
def h05_merged_spans(spark, sf_dir):
    return intervals.merged(spans(spark, sf_dir), "key").select("key", "start", "end", "parts")


@query(f"""WITH {SPANS}, days AS (SELECT DISTINCT key, unnest(range(greatest(start, 1000), least("end", 2500))) AS d FROM spans WHERE "end" > 1000 AND start < 2500), keys AS (SELECT DISTINCT key FROM spans), every AS (SELECT key, unnest(range(1000, 2500)) AS d FROM keys),
missing AS (SELECT key, d, d - row_number() OVER (PARTITION BY key ORDER BY d) AS g FROM (SELECT * FROM every EXCEPT SELECT * FROM days)) SELECT key, min(d)::BIGINT AS start, max(d)::BIGINT + 1 AS "end" FROM missing GROUP BY key, g""")
def h05_gap_planning(spark, sf_dir):
    s = spans(spark, sf_dir)
    asked = s.select("key").distinct().withColumns({"start": F.lit(1000).cast("long"), "end": F.lit(2500).cast("long")})
    return intervals.gaps(asked, s, "key")


@query(f"""WITH {SPANS}, keys AS (SELECT DISTINCT key FROM spans), asked AS (SELECT key, 1500 AS start, 1560 AS "end", true AS asked FROM keys), every AS (SELECT * FROM asked UNION ALL SELECT key, start, "end", false FROM spans), {islands_sql("every", ">=")}, bounds AS (SELECT key, island, min(start) AS a, max("end") AS b FROM islands GROUP BY 1, 2),
{islands_sql("spans", ">", "stored")}, whole AS (SELECT key, min(start) AS s, max("end") AS e FROM stored GROUP BY key, island)
SELECT i.key, i.start::BIGINT AS start, i."end"::BIGINT AS "end", EXISTS (SELECT 1 FROM whole w WHERE w.key = i.key AND w.s <= 1500 AND w.e >= 1560) AS covered, a::BIGINT AS fetch_start, b::BIGINT AS fetch_end FROM islands i JOIN bounds USING (key, island) WHERE asked""")
def h06_refresh_planning(spark, sf_dir):
    s = spans(spark, sf_dir)
    asked = s.select("key").distinct().withColumns({"start": F.lit(1500).cast("long"), "end": F.lit(1560).cast("long")})
    return intervals.refresh_plan(asked, s, "key")


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS m, strftime(o_orderdate + INTERVAL 2 WEEK, '%Y-%m-%d') AS w FROM orders")
def h07_coverage_end(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select("o_orderkey", day(intervals.coverage_end(F.col("at"), 1, "mo")).alias("m"), day(intervals.coverage_end(F.col("at"), 2, "wk")).alias("w"))


@query(f"""WITH {SPANS}, x AS (SELECT DISTINCT key, start // 30 AS start, start // 30 + 1 AS "end" FROM spans), n AS (SELECT *, (row_number() OVER (PARTITION BY start, "end" ORDER BY key) - 1) // 5 AS g FROM x) SELECT start, "end", string_agg(key::VARCHAR, ',' ORDER BY key) AS keys FROM n GROUP BY start, "end", g""")
def h08_request_groups(spark, sf_dir):
    month = F.floor(F.col("start") / 30)
    s = spans(spark, sf_dir).select("key", month.alias("start"), (month + 1).alias("end")).distinct()
    found = intervals.request_groups(s, "key", 5)
    return found.select("start", "end", F.concat_ws(",", F.col("keys").cast("array<string>")).alias("keys"))


@query("""WITH p AS (SELECT c_custkey AS key, c_custkey % 3 = 0 AS covered, c_acctbal > 3000 AS stored, c_acctbal > 6000 AS whole FROM customer), a AS (SELECT o_custkey AS key, count(*) FILTER (o_orderstatus = 'F') AS rows FROM orders GROUP BY 1)
SELECT key, CASE WHEN covered THEN 'skipped' WHEN rows IS NULL THEN 'failed' WHEN rows = 0 THEN 'empty' WHEN stored AND whole THEN 'refreshed' WHEN stored THEN 'merged' ELSE 'saved' END AS status FROM p LEFT JOIN a USING (key)""")
def h09_batch_outcomes(spark, sf_dir):
    plan = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 3 == 0).alias("covered"), (F.col("c_acctbal") > 3000).alias("stored"), (F.col("c_acctbal") > 6000).alias("whole"))
    came = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("rows"))
    return intervals.outcomes(plan, came, "key").select("key", "status")


@query(f"WITH {S}, c AS (SELECT symbol, year(ts) AS y, min(ts) AS f, max(ts) AS l, count(*) AS n FROM bars GROUP BY 1, 2) SELECT symbol, y, epoch(f)::BIGINT AS f, epoch(l)::BIGINT AS l, n FROM c WHERE f < TIMESTAMP '1997-07-01' AND l >= TIMESTAMP '1995-03-01'")
def a05_coverage(spark, sf_dir):
    found = intervals.coverage(ship_bars(spark, sf_dir).withColumn("y", F.year("ts").cast("long")), "symbol", "y")
    found = intervals.overlapping(found, "1995-03-01", "1997-07-01")
    return found.select("symbol", "y", F.unix_seconds("first_ts").alias("f"), F.unix_seconds("last_ts").alias("l"), F.col("row_count").alias("n"))


@query(f"WITH {S}, a AS (SELECT * FROM bars WHERE ts < TIMESTAMP '1999-01-01'), b AS (SELECT symbol, ts, open, high, low, CASE WHEN day(ts) = 3 THEN close + 1 ELSE close END AS close, volume FROM bars WHERE ts >= TIMESTAMP '1996-06-01') SELECT state, count(*) AS n FROM (SELECT CASE WHEN b.ts IS NULL THEN 'lost' WHEN a.ts IS NULL THEN 'added' WHEN a.close = b.close THEN 'kept' ELSE 'revised' END AS state FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts) GROUP BY state")
def a21_refresh(spark, sf_dir):
    bars = ship_bars(spark, sf_dir)
    fresh = bars.where("ts >= timestamp '1996-06-01'").withColumn("close", F.when(F.dayofmonth("ts") == 3, F.col("close") + 1).otherwise(F.col("close")))
    return intervals.refresh(bars.where("ts < timestamp '1999-01-01'"), fresh).groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey - 7 AS p, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 11 END AS s FROM orders), gone AS (SELECT DISTINCT s FROM r WHERE s IS NOT NULL)
SELECT id, NOT (id IN (SELECT s FROM gone) OR p IN (SELECT s FROM gone)) AS active FROM r""")
def a23_superseded(spark, sf_dir):
    k = F.col("o_orderkey")
    r = read(spark, sf_dir, "orders").select(k.alias("revision_id"), F.array(k - 7).alias("parent_ids"), F.when(k % 5 == 0, F.array(k - 11)).otherwise(F.array().cast("array<bigint>")).alias("supersedes"))
    return intervals.superseded(r).select(F.col("revision_id").alias("id"), "active")


@query(f"WITH {S} SELECT symbol, count(*) FILTER (ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1999-01-01') AS removed, count(*) FILTER (ts < TIMESTAMP '1997-01-01') AS before, count(*) FILTER (ts >= TIMESTAMP '1999-01-01') AS after FROM bars GROUP BY symbol")
def a24_range_delete(spark, sf_dir):
    return intervals.range_delete(ship_bars(spark, sf_dir), "1997-01-01", "1999-01-01")[1]


@query("SELECT o_custkey AS key, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'unknown' WHEN bool_or(o_orderstatus = 'P') THEN 'partial' ELSE 'complete' END AS status, CASE WHEN bool_or(skipped) THEN 'some' WHEN count(*) FILTER (skipped IS NULL) > 0 THEN 'unknown' ELSE 'none' END AS skipped, count(*) AS reports FROM (SELECT *, CASE WHEN o_orderpriority < '3' THEN o_totalprice > 300000 WHEN o_orderpriority < '4' THEN NULL ELSE false END AS skipped FROM orders) GROUP BY 1")
def d22_merge_quality(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "unknown").when(F.col("o_orderstatus") == "P", "partial").otherwise("complete")
    skipped = F.when(F.col("o_orderpriority") < "3", F.col("o_totalprice") > 300000).when(F.col("o_orderpriority") < "4", F.lit(None).cast("boolean")).otherwise(False)
    found = intervals.merge_quality(o.select(F.col("o_custkey").alias("key"), status.alias("status"), skipped.alias("skipped")), "key")
    return found.select("key", "status", F.when(F.col("skipped").isNull(), "unknown").when(F.col("skipped"), "some").otherwise("none").alias("skipped"), "reports")


@query("SELECT key, epoch(d)::BIGINT AS t, round(min(o_totalprice), 2) AS content, min(o_totalprice) <> max(o_totalprice) AS conflict FROM (SELECT o_custkey AS key, date_trunc('month', o_orderdate) AS d, o_totalprice FROM orders) JOIN (SELECT o_custkey AS key, max(date_trunc('month', o_orderdate)) AS d FROM orders GROUP BY 1) USING (key, d) GROUP BY 1, 2")
def c09_latest_revision(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("at"), "o_totalprice")
    return intervals.latest_revision(o, "key", "at", "o_totalprice").select("key", F.unix_seconds("at").alias("t"), F.round("o_totalprice", 2).alias("content"), "conflict")


def events(spark, sf_dir):
    """Corporate actions from the large orders, dealt over the shipping series."""
    o = read(spark, sf_dir, "orders").where("o_totalprice > 250000")
    k = F.col("o_orderkey")
    symbol = F.element_at(F.array(*[F.lit(x) for x in ("AF", "NF", "NO", "RF")]), (F.floor(k / 40) % 4 + 1).cast("int"))
    kind = F.when(k % 3 == 0, "split").when(k % 3 == 1, "cash_dividend").otherwise("merger")
    return o.select(
        k.alias("event_id"), symbol.alias("symbol"), kind.alias("event_type"), F.col("o_orderdate").cast("timestamp").alias("effective_ts"), (2 + k % 3).cast("double").alias("share_ratio"),
        F.when(k % 7 == 0, 0.97).alias("price_factor"), (1 + k % 5).cast("double").alias("cash_amount"), F.lit(100.0).alias("reference_close"), F.when(k % 11 == 0, "EUR").otherwise("USD").alias("currency"), F.when(k % 13 == 0, "cancelled").otherwise("confirmed").alias("status"),
    )


EVENTS = """acts AS (SELECT o_orderkey AS event_id, (['AF', 'NF', 'NO', 'RF'])[(o_orderkey // 40) % 4 + 1] AS symbol, CASE o_orderkey % 3 WHEN 0 THEN 'split' WHEN 1 THEN 'cash_dividend' ELSE 'merger' END AS event_type, o_orderdate AS effective_ts, (2 + o_orderkey % 3)::DOUBLE AS share_ratio,
  CASE WHEN o_orderkey % 7 = 0 THEN 0.97::DOUBLE END AS price_factor, (1 + o_orderkey % 5)::DOUBLE AS cash_amount, CASE WHEN o_orderkey % 11 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN o_orderkey % 13 = 0 THEN 'cancelled' ELSE 'confirmed' END AS status FROM orders WHERE o_totalprice > 250000
), factored AS (SELECT *, CASE event_type WHEN 'split' THEN 1 / share_ratio WHEN 'cash_dividend' THEN coalesce(price_factor, (100 - cash_amount) / 100) END AS price, CASE event_type WHEN 'split' THEN share_ratio ELSE 1.0 END AS vol,
  count(*) FILTER (event_type <> 'merger') OVER (PARTITION BY symbol, timezone('America/New_York', timezone('UTC', effective_ts))::DATE) > 1 AS shared FROM acts
), faulted AS (SELECT *, CASE WHEN event_type = 'merger' THEN 'unsupported' WHEN event_type = 'cash_dividend' AND price_factor IS NULL AND shared THEN 'needs an explicit factor' WHEN event_type = 'cash_dividend' AND price_factor IS NULL AND currency <> 'USD' THEN 'currency' ELSE 'good' END AS fault FROM factored)"""


@query(f"WITH {EVENTS} SELECT event_id, fault, round(price, 9) AS price, vol FROM faulted WHERE event_type <> 'merger'")
def i02_event_factors(spark, sf_dir):
    found = actions.event_factors(events(spark, sf_dir)).where("event_type <> 'merger'")
    return found.select("event_id", F.coalesce("fault", F.lit("good")).alias("fault"), F.round("price", 9).alias("price"), F.col("volume").alias("vol"))


@query(f"""WITH {S}, {EVENTS}, good AS (SELECT f.* FROM faulted f JOIN (SELECT symbol, min(ts) AS first FROM bars GROUP BY 1) b USING (symbol) WHERE fault = 'good' AND status <> 'cancelled' AND effective_ts > first AND timezone('America/New_York', timezone('UTC', effective_ts))::DATE <= DATE '1996-12-31')
SELECT b.symbol, epoch(b.ts)::BIGINT AS t, round(ln(any_value(close)) + coalesce(sum(ln(price)), 0), 6) AS log_close, round(ln(any_value(volume)) + coalesce(sum(ln(vol)), 0), 6) AS log_volume FROM bars b LEFT JOIN good g ON g.symbol = b.symbol AND g.effective_ts > b.ts GROUP BY b.symbol, b.ts""")
def i01_adjusted_bars(spark, sf_dir):
    bars = ship_bars(spark, sf_dir)
    good = actions.event_factors(events(spark, sf_dir)).where("fault is null")
    found = actions.adjust(bars, actions.relevant(good, bars, "1996-12-31"), logs=True)
    return found.select("symbol", F.unix_seconds("ts").alias("t"), F.round("close", 6).alias("log_close"), F.round("volume", 6).alias("log_volume"))


@query(f"WITH {EVENTS} SELECT event_id, round(cash_amount * coalesce((SELECT exp(sum(ln(share_ratio))) FROM acts s WHERE s.symbol = d.symbol AND s.event_type = 'split' AND s.effective_ts > d.effective_ts AND s.effective_ts < TIMESTAMP '1998-01-01'), 1), 4) AS original FROM acts d WHERE event_type = 'cash_dividend'")
def i10_restored_dividends(spark, sf_dir):
    e = events(spark, sf_dir)
    splits = e.where("event_type = 'split' and effective_ts < timestamp '1998-01-01'").select("symbol", F.col("effective_ts").alias("ts"), F.col("share_ratio").alias("ratio"))
    paid = e.where("event_type = 'cash_dividend'").select("event_id", "symbol", F.col("effective_ts").alias("ts"), F.col("cash_amount").alias("amount"))
    return actions.split_restored(paid, splits).select("event_id", F.round("original", 4).alias("original"))


@query("SELECT p_partkey, (round(r) >= 2 AND abs(r - round(r)) <= 1e-9) OR (round(1 / r) >= 2 AND abs(1 / r - round(1 / r)) <= 1e-9) AS simple FROM (SELECT p_partkey, (1 + p_partkey % 6) / (1.0 + p_size % 4)::DOUBLE AS r FROM part)")
def i11_simple_splits(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", actions.simple_split((1 + F.col("p_partkey") % 6) / (1.0 + F.col("p_size") % 4)).alias("simple"))


def metrics(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return o.groupBy(F.col("o_custkey").alias("ticker")).agg(rollup.exact_sum(F.when(F.col("o_orderstatus") == "F", price)).alias("a"), rollup.exact_sum(F.when(F.col("o_orderpriority").startswith("1"), price)).alias("b"))


METRICS = "metrics AS (SELECT o_custkey AS ticker, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS a, sum(CASE WHEN starts_with(o_orderpriority, '1') THEN o_totalprice END) AS b FROM orders GROUP BY 1)"


_REDUCERS = {
    "single": "CASE WHEN count(*) = 1 THEN max(o_totalprice) END", "first": "arg_min(o_totalprice, o_orderkey)", "last": "arg_max(o_totalprice, o_orderkey)", "sum": "sum(o_totalprice)",
    "mean": "avg(o_totalprice)", "min": "min(o_totalprice)", "max": "max(o_totalprice)", "count": "count(o_totalprice)",
}


@query(" UNION ALL ".join(f"SELECT o_custkey AS key, '{how}' AS how, round(({sql})::DOUBLE, 4) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1" for how, sql in _REDUCERS.items()))
def d10_reducers(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    one = [rollup.reduce_metric(o, "key", "o_totalprice", how, "o_orderkey", ("o_orderstatus", "F")).withColumn("how", F.lit(how)) for how in _REDUCERS]
    return reduce(DataFrame.union, one).select("key", "how", F.round("metric", 4).alias("value"))


@query(f"WITH {METRICS} SELECT 'a' AS metric, round(sum(a), 3) AS total, round(avg(a), 3) AS mean, count(a) AS contributors FROM metrics UNION ALL SELECT 'b', round(sum(b), 3), round(avg(b), 3), count(b) FROM metrics")
def d11_across_tickers(spark, sf_dir):
    found = rollup.across_tickers(metrics(spark, sf_dir), "a", "b")
    return found.select("metric", F.round("total", 3).alias("total"), F.round("mean", 3).alias("mean"), "contributors")


@query(f"WITH {METRICS} SELECT round(100 * sum(a) / sum(b), 6) AS ratio, count(*) AS contributors FROM metrics WHERE a IS NOT NULL AND b IS NOT NULL")
def d12_ratio_of_sums(spark, sf_dir):
    return rollup.ratio_of_sums(metrics(spark, sf_dir), "a", "b", 100.0).select(F.round("ratio", 6).alias("ratio"), "contributors")


@query(f"WITH {METRICS} SELECT ticker, row_number() OVER (ORDER BY b DESC NULLS LAST, ticker) AS place FROM metrics")
def g03_ranked_metrics(spark, sf_dir):
    return rollup.ranked(metrics(spark, sf_dir), "b", "ticker").select("ticker", F.col("place").cast("long").alias("place"))


@query("SELECT s.status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY 1")
def d23_status_counts(spark, sf_dir):
    return rollup.status_counts(read(spark, sf_dir, "orders"), F.col("o_orderstatus"), ["F", "O", "P", "X"])


@query()
def d24_fingerprint(spark, sf_dir):
    return rollup.fingerprint(event_bars(spark, sf_dir))


_FLAT = f"""WITH RECURSIVE {H}, {NUMBERED_SQL}, cand AS (SELECT e.symbol, e.rn AS end_rn, s.rn AS start_rn, max(b.high) AS hi, min(b.low) AS lo FROM numbered e JOIN numbered s ON s.symbol = e.symbol AND s.rn BETWEEN e.rn - 11 AND e.rn - 2 JOIN numbered b ON b.symbol = e.symbol AND b.rn BETWEEN s.rn AND e.rn GROUP BY 1, 2, 3),
flat AS (SELECT symbol, end_rn, min(start_rn) AS start_rn FROM cand WHERE 200 * (hi - lo) / (hi + lo) <= 120 * (1 + 1e-12) GROUP BY 1, 2), described AS (SELECT f.*, hi, lo FROM flat f JOIN cand c USING (symbol, end_rn, start_rn))"""


def flats(spark, sf_dir):
    return detect.flat_windows(event_bars(spark, sf_dir), 3, 12, limit=120.0)


@query(f"{_FLAT} SELECT symbol, start_rn, end_rn, round((hi + lo) / 2, 6) AS mid, round(200 * (hi - lo) / (hi + lo), 6) AS width FROM described")
def f01_flat_windows(spark, sf_dir):
    return flats(spark, sf_dir).select("symbol", F.col("start_rn").cast("long").alias("start_rn"), F.col("end_rn").cast("long").alias("end_rn"), F.round("mid", 6).alias("mid"), F.round("width", 6).alias("width"))


@query(f"""{_FLAT} SELECT f.symbol, f.start_rn, f.end_rn, f.end_rn - f.start_rn + 1 AS bars, 120.0 AS allowed, round(max(200 * (b.high - b.low) / (b.high + b.low)), 6) AS longest, round(median(200 * (b.high - b.low) / (b.high + b.low)), 6) AS median
FROM flat f JOIN numbered b ON b.symbol = f.symbol AND b.rn BETWEEN f.start_rn AND f.end_rn GROUP BY f.symbol, f.start_rn, f.end_rn""")
def f10_flat_records(spark, sf_dir):
    """The widths of the bars in each flat stretch."""
    rounded = [F.round(c, 6).alias(n) for c, n in (("longest_bar_width", "longest"), ("median_bar_width", "median"))]
    return flats(spark, sf_dir).select("symbol", F.col("start_rn").cast("long").alias("start_rn"), F.col("end_rn").cast("long").alias("end_rn"), F.col("bars").cast("long").alias("bars"), F.col("limit").alias("allowed"), *rounded)


@query(f"""WITH {H}, {NUMBERED_SQL}, cand AS (SELECT e.symbol, e.rn AS end_rn, s.rn AS start_rn, max(b.high) AS hi, min(b.low) AS lo, quantile_cont(200 * (b.high - b.low) / (b.high + b.low), 0.9) AS q, quantile_cont(200 * (b.high - b.low) / (b.high + b.low), 0.5) AS m, max(200 * (b.high - b.low) / (b.high + b.low)) AS w
  FROM numbered e JOIN numbered s ON s.symbol = e.symbol AND s.rn BETWEEN e.rn - 7 AND e.rn - 2 JOIN numbered b ON b.symbol = e.symbol AND b.rn BETWEEN s.rn AND e.rn GROUP BY 1, 2, 3)
SELECT symbol, end_rn, min(start_rn) AS start_rn FROM cand WHERE 200 * (hi - lo) / (hi + lo) <= 1.2 * q * (1 + 1e-12) AND w <= 3 * m * (1 + 1e-12) GROUP BY 1, 2""")
def f02_automatic_flats(spark, sf_dir):
    found = detect.flat_windows(event_bars(spark, sf_dir), 3, 8, percentile=0.9, multiplier=1.2, longest_bar=3.0)
    return found.select("symbol", F.col("end_rn").cast("long").alias("end_rn"), F.col("start_rn").cast("long").alias("start_rn"))


@query(f"{_FLAT}, picked AS (SELECT symbol, max(end_rn) AS end_rn, arg_max(start_rn, end_rn) AS start_rn FROM flat GROUP BY symbol UNION ALL SELECT p.symbol, n.end_rn, n.start_rn FROM picked p, LATERAL (SELECT end_rn, start_rn FROM flat f WHERE f.symbol = p.symbol AND f.end_rn < p.start_rn ORDER BY end_rn DESC LIMIT 1) n) SELECT symbol, start_rn, end_rn FROM picked")
def f07_disjoint_flats(spark, sf_dir):
    found = detect.disjoint_latest(flats(spark, sf_dir))
    return found.select("symbol", F.col("start_rn").cast("long").alias("start_rn"), F.col("end_rn").cast("long").alias("end_rn"))


@query(f"""{_FLAT}, p AS (SELECT * FROM flat), r AS (SELECT p.symbol, p.start_rn, p.end_rn, b.*, close / lag(close) OVER (PARTITION BY p.symbol, p.start_rn, p.end_rn ORDER BY b.rn) - 1 AS ret FROM p JOIN numbered b ON b.symbol = p.symbol AND b.rn BETWEEN p.start_rn AND p.end_rn)
SELECT symbol, start_rn, end_rn, count(*) AS bars, count(*) FILTER (close < open) AS red, count(*) FILTER (close < open AND high > open * 1.01) AS red_above, count(*) FILTER (high > open * 1.01) AS above, round(100 * stddev_pop(ret), 6) AS volatility FROM r GROUP BY 1, 2, 3""")
def d15_flat_statistics(spark, sf_dir):
    found = detect.flat_statistics(flats(spark, sf_dir), event_bars(spark, sf_dir), 1.01)
    return found.select("symbol", F.col("start_rn").cast("long").alias("start_rn"), F.col("end_rn").cast("long").alias("end_rn"), "bars", "red", "red_above", "above", F.round("volatility", 6).alias("volatility"))


@query(f"""{_FLAT}, picked AS (SELECT symbol, max(end_rn) AS end_rn, arg_max(start_rn, end_rn) AS start_rn FROM flat GROUP BY symbol UNION ALL SELECT p.symbol, n.end_rn, n.start_rn FROM picked p, LATERAL (SELECT end_rn, start_rn FROM flat f WHERE f.symbol = p.symbol AND f.end_rn < p.start_rn ORDER BY end_rn DESC LIMIT 1) n),
r AS (SELECT p.symbol, p.start_rn, b.*, close / lag(close) OVER (PARTITION BY p.symbol, p.start_rn ORDER BY b.rn) - 1 AS ret FROM picked p JOIN numbered b ON b.symbol = p.symbol AND b.rn BETWEEN p.start_rn AND p.end_rn)
SELECT symbol, count(DISTINCT start_rn) AS periods, count(*) AS bars, count(*) FILTER (close < open) AS red, round(count(*) FILTER (close < open AND high > open * 1.02) / nullif(count(*) FILTER (close < open), 0), 6) AS red_above_share, count(ret) AS returns, round(100 * stddev_pop(ret), 5) AS volatility FROM r GROUP BY symbol""")
def d16_pooled_volatility(spark, sf_dir):
    """Over the disjoint flat periods of each symbol, all their returns together."""
    periods = detect.disjoint_latest(flats(spark, sf_dir)).select("symbol", F.col("start_rn").cast("long").alias("start_rn"), F.col("end_rn").cast("long").alias("end_rn"))
    found = detect.pooled_statistics(detect.flat_statistics(periods, event_bars(spark, sf_dir), 1.02))
    return found.select("symbol", "periods", "bars", "red", F.round("red_above_share", 6).alias("red_above_share"), "returns", F.round("volatility", 5).alias("volatility"))


_EVIDENCE = f"""{H}, {NUMBERED_SQL}, x AS (SELECT *, ln(close) AS x, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY ts) AS r FROM numbered), lengths AS (SELECT * FROM (VALUES (8), (9), (15), (16), (17)) l(n)), spread AS (SELECT symbol, n, x, r, rn AS at_, unnest(range(rn, rn + n)) AS rn FROM x, lengths), j AS (
  SELECT s.symbol, e.ts, s.rn, n, max(s.x) - min(s.x) < 1e-13 AS flat, regr_slope(s.x, at_) AS slope, regr_r2(s.x, at_) AS r2, greatest(stddev_samp(CASE WHEN at_ > s.rn - n + 1 THEN s.r END), 1e-8) AS sigma,
    sum(CASE WHEN at_ > s.rn - n + 1 THEN abs(s.r) END) AS path, sum(CASE WHEN at_ > s.rn - n + 1 THEN s.r END) AS net
  FROM spread s JOIN x e ON e.symbol = s.symbol AND e.rn = s.rn WHERE s.rn >= n GROUP BY ALL
), couples AS (
  SELECT a.symbol, a.rn AS a, b.rn AS b, (b.x - a.x) / (b.rn - a.rn) AS rise FROM x a JOIN x b ON b.symbol = a.symbol AND b.rn > a.rn AND b.rn < a.rn + 17
), p AS (
  SELECT symbol, rn, n, median(rise) AS robust, avg(sign(rise)) AS ordering FROM (SELECT symbol, n, rise, unnest(range(b, a + n)) AS rn FROM couples, lengths WHERE b - a < n) WHERE rn >= n GROUP BY ALL
), k AS (
  SELECT j.symbol, ts, j.rn, j.n, CASE WHEN flat THEN 0 ELSE slope END AS slope, CASE WHEN flat THEN 0 ELSE coalesce(r2, 0) END AS r2, CASE WHEN flat THEN 0 ELSE robust END AS robust, sigma, ordering, CASE WHEN path = 0 THEN 0 ELSE net / path END AS efficiency FROM j JOIN p USING (symbol, rn, n)
), v AS (
  SELECT *, slope * sqrt(n - 1) / sigma AS z, abs(robust) * sqrt(n - 1) / sigma AS magnitude, 0.25 * r2 * tanh(slope * sqrt(n - 1) / sigma / 2) + 0.2 * tanh(robust * sqrt(n - 1) / sigma / 2) + 0.35 * ordering + 0.2 * efficiency AS evidence FROM k
), w AS (
  SELECT v.*, sign(v.evidence) AS direction, abs(v.evidence) AS clarity, avg(CASE WHEN sign(v.evidence) * m.evidence >= 0.55 AND sign(v.evidence) * m.robust > 0 THEN 1.0 ELSE 0.0 END) AS boundary
  FROM v JOIN v m ON m.symbol = v.symbol AND m.rn = v.rn AND m.n BETWEEN v.n - 1 AND v.n + 1 WHERE v.n IN (8, 16) GROUP BY ALL
)"""


def _trends(spark, sf_dir):
    return detect.trend_evidence(event_bars(spark, sf_dir), (8, 16))


_MEASURES = ("slope", "r2", "robust", "sigma", "efficiency", "ordering", "z", "magnitude", "evidence", "clarity", "direction", "boundary")


@query(f"WITH {_EVIDENCE} SELECT symbol, epoch(ts)::BIGINT AS t, n AS lookback, {', '.join(f'round({c}, 6) AS {c}' for c in _MEASURES)} FROM w")
def f11_trend_evidence(spark, sf_dir):
    return _trends(spark, sf_dir).select("symbol", F.unix_seconds("ts").alias("t"), "lookback", *[F.round(c, 6).alias(c) for c in _MEASURES])


@query(f"""WITH {_EVIDENCE}, g AS (SELECT *, concat_ws(', ', CASE WHEN clarity < 0.45 THEN 'clarity' END, CASE WHEN magnitude < 1 THEN 'magnitude' END, CASE WHEN direction * robust <= 0 THEN 'slope disagrees' END, CASE WHEN boundary < 0.8 THEN 'boundary' END) AS reasons FROM w),
far AS (SELECT symbol, rn, max(n) AS far, arg_max(direction, n) AS way FROM g WHERE reasons = '' GROUP BY 1, 2)
SELECT g.symbol, epoch(ts)::BIGINT AS t, n AS lookback, reasons, CASE WHEN reasons = '' THEN far > n AND way <> direction END AS countertrend FROM g LEFT JOIN far ON far.symbol = g.symbol AND far.rn = g.rn""")
def f12_trend_gates(spark, sf_dir):
    gated = detect.trend_gates(_trends(spark, sf_dir), clarity=0.45)
    counter = detect.countertrends(gated.where("accepted")).select("symbol", "rn", "lookback", "countertrend")
    return gated.join(counter, ["symbol", "rn", "lookback"], "left").select("symbol", F.unix_seconds("ts").alias("t"), "lookback", "reasons", "countertrend")


_RECORDS = f"""{_EVIDENCE}, taken AS (SELECT symbol, ts, rn, n, slope, direction, sigma FROM w WHERE clarity >= 0.3), r_rows AS (
  SELECT t.*, x.x, x.ts AS at, x.rn AS place, first_value(x.x) OVER q AS head, last_value(x.x) OVER q AS tail, first_value(x.ts) OVER q AS start_ts FROM taken t JOIN x ON x.symbol = t.symbol AND x.rn BETWEEN t.rn - t.n + 1 AND t.rn WINDOW q AS (PARTITION BY t.symbol, t.rn, t.n ORDER BY x.rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), r_ends AS (
  SELECT symbol, ts, rn, n, any_value(slope) AS slope, any_value(direction) AS direction, any_value(sigma) AS sigma, any_value(head) AS head, any_value(tail) AS tail, any_value(start_ts) AS start_ts, max(direction * x) AS best, min(place) FILTER (direction * x = top) AS extreme
  FROM (SELECT *, max(direction * x) OVER (PARTITION BY symbol, rn, n) AS top FROM r_rows) GROUP BY symbol, ts, rn, n
), r_moves AS (
  SELECT *, greatest(0, best - direction * head) AS movement, greatest(0, best - direction * tail) AS retreat, rn - extreme AS young FROM r_ends
), records AS (
  SELECT *, retreat / greatest(movement, 1e-12) AS retracement, retreat / (sigma * sqrt(greatest(1, young))) AS shock FROM r_moves
)"""


def _records(spark, sf_dir):
    return detect.trend_records(_trends(spark, sf_dir).where("clarity >= 0.3"), event_bars(spark, sf_dir), shock=1.0)


@query(f"WITH {_RECORDS} SELECT symbol, epoch(start_ts)::BIGINT AS s, epoch(ts)::BIGINT AS e, n AS duration, direction, round(exp(slope) - 1, 6) AS rate, round(movement, 6) AS movement, round(retreat, 6) AS retreat, round(retracement, 6) AS retracement, young FROM records")
def f13_trend_records(spark, sf_dir):
    found = _records(spark, sf_dir)
    return found.select("symbol", F.unix_seconds("start_ts").alias("s"), F.unix_seconds("end_ts").alias("e"), "duration", F.col("direction").cast("int").alias("direction"), *[F.round(c, 6).alias(c) for c in ("rate", "movement", "retreat", "retracement")], "young")


@query(f"WITH {_RECORDS} SELECT symbol, epoch(ts)::BIGINT AS e, n AS duration, round(shock, 6) AS shock, young > 0 AND young < 5 AND shock >= 1 AS abrupt FROM records")
def f14_abrupt_moves(spark, sf_dir):
    return _records(spark, sf_dir).select("symbol", F.unix_seconds("end_ts").alias("e"), "duration", F.round("shock", 6).alias("shock"), "abrupt")


@query(f"WITH {_RECORDS} SELECT symbol, epoch(ts)::BIGINT AS e, n AS duration, round(exp(slope) - 1, 6) AS rate FROM records WHERE exp(slope) - 1 BETWEEN 0.005 AND 0.2 AND (n = 16 OR young = 0)")
def f15_filtered_trends(spark, sf_dir):
    """Trends by the lengths that selected them (a fresh one by none) and by slope."""
    from barspark.operators import research

    rows = _records(spark, sf_dir).withColumns({"slope": F.col("rate"), "lambda_values": F.when(F.col("young") == 0, F.array().cast("array<double>")).otherwise(F.array(F.col("duration").cast("double")))})
    found = research.filter_trends(rows, [16.0, 32.0], slopes=(0.005, 0.2), without=True)
    return found.select("symbol", F.unix_seconds("end_ts").alias("e"), "duration", F.round("rate", 6).alias("rate"))
