"""Queries on payloads, recipes and whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.plans.pipeline import Contract, registry
from barspark.queries import SESSIONS_SQL, event_bars_sql, query, sessions
from barspark.sources import payloads
from barspark.sources.bars import event_bars

H = event_bars_sql("hour")


@query(f"WITH {H} SELECT symbol, epoch(ts)::BIGINT AS t, round(open, 6) AS open, round(close, 6) AS close, volume FROM bars")
def a10_columnar_payloads(spark, sf_dir):
    rows = event_bars(spark, sf_dir).withColumn("day", F.to_date("ts")).groupBy("symbol", "day").agg(F.sort_array(F.collect_list(F.struct("ts", "open", "high", "low", "close", "volume"))).alias("r"))
    body = F.to_json(F.struct(F.transform("r", lambda x: F.unix_seconds(x["ts"])).alias("timestamp"), *[F.col(f"r.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")]))
    bars, _ = payloads.columnar_bars(rows.select("symbol", body.alias("body")))
    return bars.select("symbol", F.unix_seconds("ts").alias("t"), F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), "volume")


@query(f"WITH {H} SELECT symbol, epoch(ts)::BIGINT AS t, round(open, 6) AS open, round(high, 6) AS high FROM bars WHERE symbol <> 'view'")
def a11_row_payloads(spark, sf_dir):
    rows = event_bars(spark, sf_dir).withColumn("day", F.to_date("ts")).groupBy("symbol", "day").agg(F.collect_list(F.struct(F.unix_millis("ts").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))).alias("results"))
    body = F.to_json(F.struct(F.col("symbol").alias("ticker"), F.lit("OK").alias("status"), F.lit(False).alias("adjusted"), (F.size("results") + F.when(F.col("symbol") == "view", 1).otherwise(0)).alias("resultsCount"), "results"))
    bars, _ = payloads.row_bars(rows.select("symbol", body.alias("body")))
    return bars.select("symbol", F.unix_seconds("ts").alias("t"), F.round("open", 6).alias("open"), F.round("high", 6).alias("high"))


@query(f"WITH {H}, a AS (SELECT symbol, ts, close FROM bars UNION ALL SELECT symbol, ts, CASE WHEN volume > 3 THEN close + 1 ELSE close END FROM bars) SELECT symbol, epoch(ts)::BIGINT AS t FROM a GROUP BY symbol, ts HAVING count(DISTINCT close) = 1")
def a12_page_merge(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    again = bars.withColumn("close", F.when(F.col("volume") > 3, F.col("close") + 1).otherwise(F.col("close")))
    return payloads.merge_pages(bars.union(again))[0].select("symbol", F.unix_seconds("ts").alias("t"))


@query(f"WITH {H}, {SESSIONS_SQL} SELECT symbol, epoch(any_value(open_ts))::BIGINT AS t, round(2 * first(open ORDER BY ts), 6) AS open, round(2 * max(high), 6) AS high, sum(volume) AS volume FROM bars JOIN sessions ON ts >= open_ts AND ts < close_ts GROUP BY symbol, label")
def u02_recipe(spark, sf_dir):
    recipe = '[{"name": "scale_prices", "config": {"factor": 2.0}}, {"name": "resample_sessions", "config": {"sessions": "$sessions", "minutes": null, "source_minutes": 60, "incomplete": "aggregate"}}]'
    bars, _ = registry.load(recipe, sessions=sessions(spark)).run(event_bars(spark, sf_dir), Contract("1h"))
    return bars.select("symbol", F.unix_seconds("ts").alias("t"), F.round("open", 6).alias("open"), F.round("high", 6).alias("high"), "volume")
