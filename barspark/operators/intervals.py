"""Interval planning over stored coverage, and revisions of stored batches, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.schema import true


def coverage(rows: DataFrame, *keys: str) -> DataFrame:
    """First and last time and number of rows of each batch."""
    return rows.groupBy(*keys).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("row_count"))


def overlapping(stored: DataFrame, start: str, end: str) -> DataFrame:
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return stored.where((F.col("first_ts") < b) & (F.col("last_ts") >= a))


def coverage_end(last: Column, amount: int, unit: str) -> Column:
    """One nominal period (m, h, d, wk or mo) after the last bar; months clamp to the end of a shorter one."""
    if unit == "mo":
        return F.add_months(last, amount).cast("timestamp") + (F.unix_seconds(last) - F.unix_seconds(F.date_trunc("day", last))) * F.expr("INTERVAL 1 SECOND")
    return last + F.expr(f"INTERVAL {amount} {dict(m='MINUTE', h='HOUR', d='DAY', wk='WEEK')[unit]}")


def components(spans: DataFrame, key: str, touching: bool = True) -> DataFrame:
    """``spans(key, start, end)`` with ``island``: those that overlap, or also touch, are one."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | ((F.col("start") > reach) if touching else (F.col("start") >= reach))
    return spans.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(order)).drop("_new")


def merged(spans: DataFrame, key: str, touching: bool = True) -> DataFrame:
    return components(spans, key, touching).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts"))


def gaps(requests: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The parts of ``requests(key, start, end)``, one a key, that ``stored(key, start, end)`` does not cover, in order and disjoint."""
    asked = requests.select(key, F.col("start").alias("_from"), F.col("end").alias("_to"))
    cut = stored.join(asked, key).where("end > _from and start < _to").select(key, "_from", "_to", F.greatest("start", "_from").alias("start"), F.least("end", "_to").alias("end"))
    edges = asked.select(key, "_from", "_to", F.col("_from").alias("start"), F.col("_from").alias("end"))
    edges = edges.union(asked.select(key, "_from", "_to", F.col("_to").alias("start"), F.col("_to").alias("end")))
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return cut.union(edges).withColumn("_reach", reach).where("start > _reach").select(key, F.col("_reach").alias("start"), F.col("start").alias("end"))


def refresh_plan(requests: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Each request with ``covered``, and the span to fetch: itself and all stored spans that strictly overlap its component."""
    asked = requests.select(key, "start", "end", F.lit(True).alias("asked"))
    every = components(asked.union(stored.select(key, "start", "end", F.lit(False))), key, touching=False)
    span = every.groupBy(key, "island").agg(F.min("start").alias("fetch_start"), F.max("end").alias("fetch_end"))
    whole = merged(stored, key).select(F.col(key).alias("_key"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    plan = every.where("asked").join(span, [key, "island"])
    plan = plan.join(whole, (F.col(key) == F.col("_key")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")), "left")
    return plan.select(key, "start", "end", F.col("_s").isNotNull().alias("covered"), "fetch_start", "fetch_end")


def request_groups(spans: DataFrame, key: str, most: int) -> DataFrame:
    """Equal spans of many keys as groups of at most ``most`` sorted keys."""
    place = F.row_number().over(Window.partitionBy("start", "end").orderBy(key)) - 1
    chunk = spans.withColumn("group", F.floor(place / most))
    return chunk.groupBy("start", "end", "group").agg(F.sort_array(F.collect_list(key)).alias("keys"))  # at most `most` each


def outcomes(plan: DataFrame, arrived: DataFrame, key: str) -> DataFrame:
    """``plan(key, covered)`` with what became of it: skipped, empty, failed (nothing came) or saved, and the rows that came.

    With a column ``stored`` (bars are stored already) and ``whole`` (they are fetched anew), what came
    is ``refreshed`` where all of it was fetched anew and ``merged`` where gaps were.
    """
    joined = plan.join(arrived, key, "left")
    status = F.when(F.col("covered"), "skipped").when(F.col("rows").isNull(), "failed").when(F.col("rows") == 0, "empty")
    if "stored" in plan.columns:
        status = status.when(F.col("stored") & F.col("whole"), "refreshed").when(F.col("stored"), "merged")
    return joined.withColumn("status", status.otherwise("saved"))


def merge_quality(reports: DataFrame, key: str) -> DataFrame:
    """One report a key from ``status`` and the nullable ``skipped``: unknown if any is, skipped true if any, false only if all are."""
    status = F.when(F.bool_or(F.col("status") == "unknown"), "unknown").when(F.bool_or(F.col("status") == "partial"), "partial").otherwise("complete")
    skipped = F.when(F.bool_or("skipped"), True).when(F.count_if(F.col("skipped").isNull()) > 0, None).otherwise(False)
    return reports.groupBy(key).agg(status.alias("status"), skipped.alias("skipped"), F.count("*").alias("reports"))


def latest_revision(rows: DataFrame, key: str, at: str, content: str) -> DataFrame:
    """The newest row of each key, with ``conflict`` where rows of that newest time differ in content."""
    order = Window.partitionBy(key).orderBy(F.desc(at), content)
    newest = Window.partitionBy(key, at)
    df = rows.withColumns({"_n": F.row_number().over(order), "conflict": F.min(content).over(newest) != F.max(content).over(newest)})
    return df.where("_n = 1").drop("_n")


def superseded(revisions: DataFrame) -> DataFrame:
    """``revisions(revision_id, parent_ids, supersedes)`` with ``active``: not superseded, and not derived from what is."""
    gone = revisions.select(F.explode("supersedes").alias("revision_id")).distinct()
    parents = revisions.select("revision_id", F.explode("parent_ids").alias("parent"))
    stale = parents.join(gone.withColumnRenamed("revision_id", "parent"), "parent").select("revision_id").union(gone).distinct()
    return revisions.join(stale.withColumn("_stale", F.lit(True)), "revision_id", "left").withColumn("active", F.col("_stale").isNull()).drop("_stale")


def range_delete(bars: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """The surviving rows, and by symbol how many go, lie before and lie after."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    plan = bars.groupBy("symbol").agg(
        F.count_if((F.col("ts") >= a) & (F.col("ts") < b)).alias("removed"), F.count_if(F.col("ts") < a).alias("before"), F.count_if(F.col("ts") >= b).alias("after")
    )
    return bars.where((F.col("ts") < a) | (F.col("ts") >= b)), plan


def refresh(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` with what became of each stored key: kept, revised, added; stored keys that are lost make it invalid."""
    keys, values = ["symbol", "ts"], ["open", "high", "low", "close", "volume"]
    a = stored.select(*keys, F.struct(*values).alias("old"))
    b = fresh.select(*keys, F.struct(*values).alias("new"))
    state = F.when(F.col("new").isNull(), "lost").when(F.col("old").isNull(), "added").when(F.col("old") == F.col("new"), "kept").otherwise("revised")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))
