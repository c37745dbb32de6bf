"""Loads every module of queries, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.functions import indicators as ind
from barspark.operators.resample import resample_sessions
from barspark.queries import bars as _bars  # noqa: F401
from barspark.queries import history as _history  # noqa: F401
from barspark.queries import research as _research  # noqa: F401
from barspark.queries import sources as _sources  # noqa: F401
from barspark.queries import tables as _tables  # noqa: F401
from barspark.queries import windows as _windows  # noqa: F401
from barspark.queries import event_bars_sql, query, SESSIONS_SQL, sessions
from barspark.sources.bars import event_bars

_SQL = f"""WITH {event_bars_sql("hour")}, {SESSIONS_SQL}, daily AS (
  SELECT symbol, label, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars JOIN sessions ON ts >= open_ts AND ts < close_ts GROUP BY 1, 2
), averaged AS (
  SELECT *, row_number() OVER w AS rn, avg(close) OVER (w ROWS 2 PRECEDING) AS fast, avg(close) OVER (w ROWS 4 PRECEDING) AS slow
  FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY label)
), scored AS (
  SELECT *, coalesce(fast > slow AND lag(CASE WHEN rn >= 3 THEN fast END) OVER (PARTITION BY symbol ORDER BY label) <= lag(CASE WHEN rn >= 5 THEN slow END) OVER (PARTITION BY symbol ORDER BY label), false) AS crossed
  FROM averaged
)
SELECT strftime(label, '%Y-%m-%d') AS label, symbol, round(close, 6) AS close, round(fast, 6) AS fast, round(slow, 6) AS slow, crossed, place FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY close / slow DESC, symbol) AS place FROM scored WHERE rn >= 5) WHERE place <= 3"""


@query(_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily session bars, a fast and a slow average, crossings, and the three strongest symbols of each day."""
    daily = resample_sessions(event_bars(spark, sf_dir), sessions(spark), None, 60, "aggregate")
    rows = ind.numbered(daily).withColumns({"fast": ind.sma("close", 3), "slow": ind.sma("close", 5)})
    rows = rows.withColumn("crossed", ind.crossed_above("fast", "slow")).where("slow is not null")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.col("close") / F.col("slow")), "symbol"))
    rows = rows.withColumn("place", place).where("place <= 3")
    return rows.select(F.col("label").cast("string").alias("label"), "symbol", *[F.round(c, 6).alias(c) for c in ("close", "fast", "slow")], "crossed", F.col("place").cast("long").alias("place"))
