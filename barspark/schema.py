"""The bar table and predicates on its values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
VALUES = (*PRICES, "volume")
BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in VALUES]]
)
SESSION_SCHEMA = T.StructType([T.StructField("label", T.DateType()), T.StructField("open_ts", T.TimestampType()), T.StructField("close_ts", T.TimestampType())])


def utc(spark: SparkSession) -> SparkSession:
    """The session with its time zone set to UTC, as all operators expect."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def either(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def by_time(*keys: str):
    """Rows of a series in time order."""
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("ts")


def seconds(text: str) -> int:
    """``HH:MM`` or ``HH:MM:SS`` as seconds of the day."""
    h, m, *s = map(int, text.split(":"))
    return h * 3600 + m * 60 + (s[0] if s else 0)


def second_of_day(ts: Column | str, tz: str = "UTC") -> Column:
    local = F.from_utc_timestamp(ts, tz)
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
