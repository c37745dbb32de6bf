"""Resampling by sessions, summaries by calendar, and runs without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.guards import stopped, stopped_by
from barspark.operators.sessions import assign, expected_grid
from barspark.schema import VALUES, by_time, true


def summarise(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """Bars of groups of bars: first open, greatest high, least low, last close, total volume."""
    return rows.groupBy(*keys).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("bars")
    )


def bucket_start(minutes: int) -> Column:
    """The start of the interval of ``minutes`` from the session's opening that a bar lies in."""
    since = F.unix_micros("ts") - F.unix_micros("open_ts")
    return F.timestamp_micros(F.unix_micros("open_ts") + F.floor(since / (minutes * 60_000_000)) * (minutes * 60_000_000))


def resample_sessions(bars: DataFrame, sessions: DataFrame, minutes: int | None, source_minutes: int, incomplete: str = "drop", outside: str = "drop", calendar: DataFrame | None = None) -> DataFrame:
    """Bars of ``minutes`` from each session's opening, or one a session for None.

    ``incomplete`` is ``drop`` (only intervals with all their source bars), ``aggregate``
    (also partial ones, never empty ones) or ``raise``: any interval that lacks a source bar, also a whole one, of any symbol. Bars outside sessions
    are left out, or with ``outside="raise"`` they and bars off the grid of ``source_minutes`` from the opening are
    errors. With ``calendar``, ``sessions`` must be its sessions on the same labels. What raises does so inside the job that
    reads the bars, which reads them once.
    """
    inside = assign(bars, sessions)
    if outside == "raise":
        inside = stopped(inside, F.col("label").isNull(), F.concat(F.lit("bar outside all sessions: "), F.col("symbol"), F.lit(" "), F.col("ts").cast("string")), "ts")
        inside = stopped(inside, (F.unix_seconds("ts") - F.unix_seconds("open_ts")) % (60 * source_minutes) != 0, "bar off the grid of its session", "ts")
    elif outside == "drop":
        inside = inside.where("label is not null")
    else:
        raise ValueError("outside is drop or raise")
    if calendar is not None:
        inside = stopped_by(inside, differing_sessions(sessions, calendar), "the sessions differ from the calendar", "ts")
    start = bucket_start(minutes) if minutes else F.col("open_ts")
    rows = summarise(inside.withColumn("start", start), "symbol", "label", "open_ts", "close_ts", "start")
    end = F.least(F.col("start") + F.expr(f"INTERVAL {minutes} MINUTES"), "close_ts") if minutes else F.col("close_ts")
    due = F.ceil((F.unix_seconds(end) - F.unix_seconds("start")) / (60 * source_minutes))
    rows = rows.withColumns({"expected": due, "missing": due - F.col("bars")})
    if incomplete == "raise":
        grid = expected_grid(sessions, minutes) if minutes else sessions
        rows = rows.withColumn("_of", F.count("*").over(Window.partitionBy("symbol"))).crossJoin(F.broadcast(grid.agg(F.count("*").alias("_due"))))  # one row
        rows = stopped(rows, (F.col("missing") != 0) | (F.col("_of") != F.col("_due")), F.concat(F.lit("intervals lack source bars: "), F.col("symbol")), "start")
    elif incomplete == "drop":
        rows = rows.where("missing = 0")
    elif incomplete != "aggregate":
        raise ValueError("incomplete is drop, aggregate or raise")
    return rows.select("symbol", "label", F.col("start").alias("ts"), "open", "high", "low", "close", "volume", "expected", F.col("bars").alias("observed"))


def resample_hourly_to_daily(bars: DataFrame, sessions: DataFrame, incomplete: str = "raise") -> DataFrame:
    """A bar a session of hourly bars; a bar out of session or off the hour from its opening is always an error."""
    return resample_sessions(bars, sessions, None, 60, incomplete, outside="raise")


def resample_regular_hours(bars: DataFrame, sessions: DataFrame, calendar: DataFrame, incomplete: str = "drop", source_minutes: int = 1) -> DataFrame:
    """Half-hour bars of regular sessions only, which must be those of ``calendar``."""
    return resample_sessions(bars, sessions, 30, source_minutes, incomplete, calendar=calendar)


def differing_sessions(sessions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Labels of ``sessions`` that ``calendar`` lacks or gives other hours, and labels that it repeats."""
    due = calendar.select("label", F.col("open_ts").alias("_open"), F.col("close_ts").alias("_close"))
    met = sessions.join(due, "label", "left")
    odd = ~(true(F.col("open_ts") == F.col("_open")) & true(F.col("close_ts") == F.col("_close")))
    twice = sessions.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    return met.where(odd).select("label").union(twice.select("label"))


def quality_report(bars: DataFrame, sessions: DataFrame, minutes: int | None, source_minutes: int) -> DataFrame:
    """Each interval of each symbol that lacks source bars, also those without any."""
    grid = expected_grid(sessions, minutes) if minutes else sessions.select("label", F.col("open_ts").alias("ts"), F.col("close_ts").alias("end_ts"))
    grid = grid.withColumn("expected", F.ceil((F.unix_seconds("end_ts") - F.unix_seconds("ts")) / (60 * source_minutes)))
    inside = assign(bars, sessions).where("label is not null")
    seen = inside.groupBy("symbol", (bucket_start(minutes) if minutes else F.col("open_ts")).alias("ts")).agg(F.count("*").alias("observed"))
    due = bars.select("symbol").distinct().crossJoin(grid)  # every symbol owes every interval of the calendar
    full = due.join(seen, ["symbol", "ts"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return full.select("symbol", "label", "ts", "expected", "observed", (F.col("expected") - F.col("observed")).alias("missing")).where("missing <> 0")


def outside_count(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    return assign(bars, sessions).groupBy("symbol").agg(F.count_if(F.col("label").isNull()).alias("outside"))


def off_session_grid(bars: DataFrame, sessions: DataFrame, minutes: int = 60) -> DataFrame:
    """Bars in a session but not on its grid from the opening."""
    return assign(bars, sessions).where((F.unix_seconds("ts") - F.unix_seconds("open_ts")) % (60 * minutes) != 0)


def calendar_summary(bars: DataFrame, weeks: int | None = None, tz: str = "UTC") -> DataFrame:
    """Bars a local day, or each ``weeks`` weeks that start on a Monday."""
    local = F.from_utc_timestamp("ts", tz)
    if weeks:
        since = F.datediff(F.to_date(F.date_trunc("week", local)), F.lit("1970-01-05").cast("date"))
        label = F.date_add(F.lit("1970-01-05").cast("date"), (F.floor(since / (7 * weeks)) * (7 * weeks)).cast("int"))
    else:
        label = F.to_date(local)
    return summarise(bars.withColumn("label", label), "symbol", "label")


def gap_runs(bars: DataFrame, minutes: int, tz: str = "UTC") -> DataFrame:
    """``bars`` with ``run``: a new one when the local date changes or over ``minutes`` pass."""
    w = by_time()
    date = F.to_date(F.from_utc_timestamp("ts", tz))
    new = true(F.lag(date).over(w) != date) | true(F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w)) > 60 * minutes)
    return bars.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w)).drop("_new")


def step_bars(bars: DataFrame, step: int, minutes: int) -> DataFrame:
    """Bars of ``step`` bars each within runs without gaps."""
    runs = gap_runs(bars, minutes)
    place = F.row_number().over(Window.partitionBy("symbol", "run").orderBy("ts")) - 1
    rows = runs.withColumn("step", F.floor(place / step))
    return summarise(rows, "symbol", "run", "step").join(rows.groupBy("symbol", "run", "step").agg(F.min("ts").alias("ts")), ["symbol", "run", "step"])


def check_resampled(bars: DataFrame, output: DataFrame, sessions: DataFrame, minutes: int | None) -> DataFrame:
    """``(symbol, ts, fault)`` where ``output`` is not what windows over the source bars of its intervals say: no such interval, or other values."""
    inside = assign(bars, sessions).where("label is not null")
    inside = inside.withColumn("start", bucket_start(minutes) if minutes else F.col("open_ts"))
    group = Window.partitionBy("symbol", "start")
    whole = group.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    due = inside.select(
        "symbol", F.col("start").alias("ts"), F.first("open").over(whole).alias("_open"), F.max("high").over(group).alias("_high"), F.min("low").over(group).alias("_low"),
        F.last("close").over(whole).alias("_close"), F.sum("volume").over(group).alias("_volume"), F.row_number().over(group.orderBy("ts")).alias("_n"),
    ).where("_n = 1").drop("_n")
    far = lambda c: F.abs(F.col(c) - F.col(f"_{c}")) > F.greatest(F.lit(1e-9), 1e-12 * F.abs(f"_{c}"))
    wrong = F.concat_ws(", ", *[F.when(true(far(c)) | F.col(c).isNull(), F.lit(c)) for c in VALUES])
    joined = output.join(due, ["symbol", "ts"], "left")
    return joined.select("symbol", "ts", F.when(F.col("_open").isNull(), "no such interval").otherwise(wrong).alias("fault")).where("fault <> ''")


def known_omissions(report: DataFrame, omissions: DataFrame, sessions: DataFrame, minutes: int | None) -> DataFrame:
    """A quality report with ``known``: how many of an interval's missing bars are ``omissions(symbol, ts)`` that are known."""
    inside = assign(omissions.select("symbol", "ts").distinct(), sessions).where("label is not null")
    counts = inside.groupBy("symbol", (bucket_start(minutes) if minutes else F.col("open_ts")).alias("ts")).agg(F.count("*").alias("known"))
    return report.join(counts, ["symbol", "ts"], "left").withColumn("known", F.least(F.coalesce("known", F.lit(0)), F.col("missing")))
