"""Session calendars, grids, and joins of bars with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.operators.validate import clock_window
from barspark.schema import true


def weekday_sessions(spark: SparkSession, first: str, last: str, open_at: str = "14:30:00", close_at: str = "21:00:00") -> DataFrame:
    """A session each weekday from ``first`` to ``last``, at fixed times in UTC."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("label"))
    at = lambda t: F.concat_ws(" ", F.col("label").cast("string"), F.lit(t)).cast("timestamp")
    return days.where(F.weekday("label") < 5).select("label", at(open_at).alias("open_ts"), at(close_at).alias("close_ts"))


def local_sessions(days: DataFrame, tz: str, open_at: str, close_at: str) -> DataFrame:
    """Sessions of ``days(label)`` from local hours; a close not after the open is on the next day.

    ``valid`` is false where a local time does not exist or comes twice at a clock change, or
    where a session opens before the one before it closes.
    """
    opened = F.concat_ws(" ", F.col("label").cast("string"), F.lit(open_at)).cast("timestamp")
    closed_on = F.date_add("label", 1) if close_at <= open_at else F.col("label")
    closed = F.concat_ws(" ", closed_on.cast("string"), F.lit(close_at)).cast("timestamp")

    def plain(local):
        back = F.from_utc_timestamp(F.to_utc_timestamp(local, tz), tz) == local
        hour = F.expr("INTERVAL 1 HOUR")
        instant = F.to_utc_timestamp(local, tz)
        twice = (F.from_utc_timestamp(instant + hour, tz) == local) | (F.from_utc_timestamp(instant - hour, tz) == local)
        return back & ~twice

    out = days.select("label", F.to_utc_timestamp(opened, tz).alias("open_ts"), F.to_utc_timestamp(closed, tz).alias("close_ts"), (plain(opened) & plain(closed)).alias("valid"))
    before = F.lag("close_ts").over(Window.partitionBy(F.lit(0)).orderBy("open_ts"))  # a calendar: a row a day
    return out.withColumn("valid", F.col("valid") & ~true(before > F.col("open_ts")))


def assign(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """``bars`` with the session (``label, open_ts, close_ts``) they start in; nulls outside all.

    Sessions do not overlap. They are spread over the dates they touch, so the join is on the
    date, and the largest opening not after the bar is the one it meets.
    """
    dates = sessions.withColumn("_date", F.explode(F.sequence(F.to_date("open_ts"), F.to_date(F.col("close_ts") - F.expr("INTERVAL 1 MICROSECOND")))))
    inside = (F.to_date("ts") == F.col("_date")) & (F.col("ts") >= F.col("open_ts")) & (F.col("ts") < F.col("close_ts"))
    return bars.join(dates, inside, "left").drop("_date")


def expected_grid(sessions: DataFrame, minutes: int) -> DataFrame:
    """``(label, ts, end_ts)`` of each bar that sessions should have; the last of a session may be short."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    starts = F.explode(F.sequence("open_ts", F.col("close_ts") - F.expr("INTERVAL 1 MICROSECOND"), step))
    return sessions.select("label", "close_ts", starts.alias("ts")).select("label", "ts", F.least(F.col("ts") + step, "close_ts").alias("end_ts"))


def grid_with_lookback(grid: DataFrame, start: str, end: str, lookback: int) -> DataFrame:
    """Grid bars in ``[start, end)`` and the ``lookback`` ones before, with ``is_support``."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    before = grid.where(F.col("ts") < a).orderBy(F.desc("ts")).limit(lookback).withColumn("is_support", F.lit(True))
    return before.union(grid.where((F.col("ts") >= a) & (F.col("ts") < b)).withColumn("is_support", F.lit(False)))


def missing_and_unexpected(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """``(symbol, ts, state)``: grid bars that a symbol lacks, and bars off the grid."""
    symbols = bars.select("symbol").distinct()
    due = symbols.crossJoin(grid.select("ts"))  # every symbol owes every bar of the calendar
    have = bars.select("symbol", "ts")
    lacking = due.join(have, ["symbol", "ts"], "left_anti").withColumn("state", F.lit("missing"))
    return lacking.union(have.join(grid.select("ts"), "ts", "left_anti").select("symbol", "ts", F.lit("unexpected")))


def extended_bounds(sessions: DataFrame, tz: str = "America/New_York") -> DataFrame:
    """Sessions with ``long_open`` 04:00 and ``long_close`` 20:00 local, 17:00 where the close is before 16:00."""
    local_close = F.date_format(F.from_utc_timestamp("close_ts", tz), "HH:mm")
    at = lambda t: F.to_utc_timestamp(F.concat_ws(" ", F.col("label").cast("string"), t).cast("timestamp"), tz)
    return sessions.withColumns({"long_open": at(F.lit("04:00:00")), "long_close": at(F.when(local_close < "16:00", F.lit("17:00:00")).otherwise(F.lit("20:00:00")))})


def unfinished(grid: DataFrame, cutoff: str) -> DataFrame:
    """Grid bars that have not ended by the cutoff."""
    return grid.where(F.col("end_ts") > F.lit(cutoff).cast("timestamp"))


def removed_by_window(sessions: DataFrame, minutes: int, start: str, end: str, tz: str) -> DataFrame:
    """``(label, ts)``: the source stamps of sessions that a clock window would take away."""
    grid = expected_grid(sessions, minutes).select("label", "ts")
    return grid.join(clock_window(grid, start, end, tz).select("label", "ts"), ["label", "ts"], "left_anti")


def calendar_mismatches(outputs: DataFrame, sessions: DataFrame) -> DataFrame:
    """``outputs(label, open_ts, close_ts)`` that no session of the calendar has with these very bounds."""
    return outputs.join(sessions.select("label", "open_ts", "close_ts"), ["label", "open_ts", "close_ts"], "left_anti")


def trading_period(bars: DataFrame, early: DataFrame, tz: str = "America/New_York") -> DataFrame:
    """Bars from 09:00 to 16:00 local, without those from an early close of ``early(label, close_ts)`` on, on its date."""
    day = F.to_date(F.from_utc_timestamp("ts", tz))
    kept = clock_window(bars, "09:00", "16:00", tz).withColumn("_day", day)
    closed = early.select(F.col("label").alias("_day"), F.col("close_ts").alias("_close"))
    return kept.join(closed, "_day", "left").where("_close is null or ts < _close").drop("_day", "_close")


def close_before(dates: DataFrame, bars: DataFrame, sessions: DataFrame, minutes: int = 1) -> DataFrame:
    """``dates(symbol, ex_date)`` with ``reference_close``: the close of the bar that ends with the last session before the date; null without that bar."""
    order = Window.orderBy("label")  # a calendar: a row a day
    spans = sessions.select("label", "close_ts", F.lead("label").over(order).alias("_next"))
    days = spans.withColumn("ex_date", F.explode(F.sequence(F.date_add("label", 1), F.coalesce("_next", F.date_add("label", 7)))))
    due = dates.join(days.select("ex_date", (F.col("close_ts") - F.expr(f"INTERVAL {minutes} MINUTES")).alias("ts")), "ex_date", "left")
    return due.join(bars.select("symbol", "ts", F.col("close").alias("reference_close")), ["symbol", "ts"], "left").drop("ts")


def out_of_range_opens(grid: DataFrame, start: str, end: str) -> DataFrame:
    """Bars ``grid(label, open_ts)`` whose label lies in ``[start, end)`` and whose opening does not."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    label = F.col("label").cast("timestamp")
    return grid.where((label >= a) & (label < b) & ~((F.col("open_ts") >= a) & (F.col("open_ts") < b)))
