"""Vendor payloads as bars and events. A body is JSON text in a column ``body`` beside its ``symbol``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.operators.validate import flag_bars
from barspark.schema import PRICES, VALUES

COLUMNAR = "timestamp array<bigint>, " + ", ".join(f"{c} array<double>" for c in VALUES)
ROWS = "ticker string, status string, adjusted boolean, resultsCount bigint, results array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double>>"
SNAPSHOT = """coverage array<struct<symbol: string, start_date: date, end_date: date, status: string, source_basis: string, security_id: string, other_events_status: string>>,
  events array<struct<event_id: string, symbol: string, event_type: string, effective_ts: timestamp, security_id: string, price_factor: double, share_ratio: double, cash_amount: double, reference_close: double, currency: string, status: string>>"""


def columnar_bars(payloads: DataFrame, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Bars of payloads of parallel arrays with epoch seconds, and ``(symbol, fault)`` of payloads whose arrays differ in length or repeat a time.

    With ``start`` or ``end`` only what lies in ``[start, end)`` counts; a payload that has nothing there gives nothing.
    """
    p = payloads.withColumn("p", F.from_json("body", COLUMNAR))
    n = F.size("p.timestamp")
    uneven = F.coalesce(F.greatest(*[F.abs(F.size(f"p.{c}") - n) for c in VALUES]) > 0, F.lit(True))
    repeated = F.size(F.array_distinct("p.timestamp")) < n
    fault = F.when(F.col("p.timestamp").isNull(), "unreadable").when(uneven, "lengths differ").when(repeated, "repeated time")
    p = p.withColumn("fault", fault)
    rows = p.where("fault is null").select("symbol", F.inline(F.arrays_zip("p.timestamp", *[f"p.{c}" for c in VALUES])))
    bars = rows.select("symbol", F.timestamp_seconds("timestamp").alias("ts"), *VALUES)
    if start:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        bars = bars.where(F.col("ts") < F.lit(end).cast("timestamp"))
    return bars, p.where("fault is not null").select("symbol", "fault")


def split_omitted(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars that a vendor gave whole, and ``(symbol, ts, reason)`` of positions that it left out: all prices missing, or broken rules."""
    flagged = flag_bars(bars)
    none = F.lit(True)
    for c in PRICES:
        none = none & (F.col(c).isNull() | F.isnan(c))
    reason = F.when(none, "all prices missing").otherwise(F.array_join("reasons", "+"))
    return flagged.where(F.size("reasons") == 0).drop("reasons"), flagged.where(F.size("reasons") > 0).select("symbol", "ts", reason.alias("reason"))


def row_bars(payloads: DataFrame, daily: bool = False, tz: str = "America/New_York") -> tuple[DataFrame, DataFrame]:
    """Bars of payloads of rows with epoch milliseconds, and the faults of others; ``daily`` labels a local midnight with its date."""
    p = payloads.withColumn("p", F.from_json("body", ROWS))
    fault = (
        F.when(F.col("p.status").isNull(), "unreadable")
        .when(~F.col("p.status").isin("OK", "DELAYED"), "status")
        .when(F.coalesce(F.col("p.ticker") != F.col("symbol"), F.lit(True)), "ticker")
        .when(F.coalesce(F.col("p.adjusted"), F.lit(True)), "adjusted")
        .when(F.col("p.resultsCount") != F.size(F.coalesce("p.results", F.array())), "row count")
    )
    p = p.withColumn("fault", fault)
    rows = p.where("fault is null").select("symbol", F.inline("p.results"))
    at = F.timestamp_millis("t")
    at = F.to_date(F.from_utc_timestamp(at, tz)).cast("timestamp") if daily else at
    bars = rows.select("symbol", at.alias("ts"), *[F.col(c[0]).alias(c) for c in VALUES])
    return bars, p.where("fault is not null").select("symbol", "fault")


def merge_pages(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars of several pages with equal rows once, and the keys that differ between pages."""
    once = bars.dropDuplicates()
    clash = once.groupBy("symbol", "ts").agg(F.count("*").alias("rows")).where("rows > 1")
    return once.join(clash.select("symbol", "ts"), ["symbol", "ts"], "left_anti"), clash


def snapshots(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coverage rows, event rows, and faults of corporate-action payloads: bare, or in an envelope with the SHA-256 of its payload text."""
    p = payloads.withColumn("_inner", F.get_json_object("body", "$.payload")).withColumn("_sum", F.get_json_object("body", "$.checksum"))
    bad = F.col("_sum").isNotNull() & (F.sha2(F.col("_inner").cast("binary"), 256) != F.col("_sum"))
    p = p.withColumn("p", F.from_json(F.coalesce("_inner", "body"), SNAPSHOT)).withColumn("fault", F.when(bad, "checksum").when(F.col("p.events").isNull() & F.col("p.coverage").isNull(), "unreadable"))
    good = p.where("fault is null")
    return good.select(F.inline("p.coverage")), good.select(F.inline("p.events")), p.where("fault is not null").select("fault")


def wide_prices(df: DataFrame, symbol: str, ts: str, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """A frame of one ticker with text columns as bars, and its rows with a value that is no number."""
    cast = {new: F.expr(f"try_cast(`{old}` AS double)") for old, new in columns.items()}
    row = df.select(F.lit(symbol).alias("symbol"), F.col(ts).cast("timestamp").alias("ts"), *[c.alias(n) for n, c in cast.items()], *[(F.col(old).isNotNull() & cast[new].isNull()).alias(f"_{new}") for old, new in columns.items()])
    flags = [F.col(f"_{n}") for n in cast]
    wrong = flags[0]
    for f in flags[1:]:
        wrong = wrong | f
    names = ["symbol", "ts", *cast]
    return row.where(~wrong).select(*names), row.where(wrong).select(*names)
