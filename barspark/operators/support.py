"""Bars before the start as warm-up, slices as of a bar, and tables of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.strategy import source_index
from barspark.schema import by_time, true


def split_support(bars: DataFrame, start: str) -> DataFrame:
    """``bars`` with ``source_index`` from 0 at the first bar not before ``start``, and ``is_support`` on those before."""
    return source_index(bars, start).withColumn("is_support", F.col("source_index") < 0)


def reported(df: DataFrame) -> DataFrame:
    """The rows of a split that are not support."""
    return df.where("source_index >= 0").drop("is_support")


def with_support(bars: DataFrame, start: str, calculate: Callable[[DataFrame], DataFrame], lookback: int | None = None) -> DataFrame:
    """``calculate`` over numbered bars from ``lookback`` bars of support on (all of it if not given), reported from ``start`` on.

    ``calculate`` gets ``rn``, from 1 at the first bar that it sees, and must keep ``source_index``.
    """
    df = split_support(bars, start)
    if lookback is not None:
        df = df.where(F.col("source_index") >= -lookback)
    return reported(calculate(df.withColumn("rn", F.row_number().over(by_time()))))


def identity_breaks(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``(symbol, ts, fault)``: keys that a result lost, added or repeats."""
    count = lambda df, name: df.groupBy("symbol", "ts").agg(F.count("*").alias(name))
    both = count(expected, "due").join(count(found, "has"), ["symbol", "ts"], "full")
    fault = F.when(F.col("has").isNull(), "lost").when(F.col("due").isNull(), "added").when(F.col("has") > F.col("due"), "repeated")
    return both.select("symbol", "ts", fault.alias("fault")).where("fault is not null")


def as_of(df: DataFrame, index: int | None = None, ts: str | None = None) -> DataFrame:
    """Rows of a split up to a source index, a time, or both."""
    if index is not None:
        df = df.where(F.col("source_index") <= index)
    return df if ts is None else df.where(F.col("ts") <= F.lit(ts).cast("timestamp"))


def stacked(support: DataFrame, selected: DataFrame) -> DataFrame:
    """Support and selected rows as one table; columns that one lacks are null there."""
    return support.unionByName(selected, allowMissingColumns=True)


def event_table(df: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Events, or intervals with an ``end``, numbered by ``ordinal`` in each symbol, with ``fault`` where an end is before its start or a time is null."""
    fault = F.when(F.col(start).isNull(), "no start")
    order = [start]
    if end:
        fault = fault.when(F.col(end).isNull(), "no end").when(F.col(end) < F.col(start), "end before start")
        order.append(end)
    return df.withColumns({"ordinal": F.row_number().over(Window.partitionBy("symbol").orderBy(*order)) - 1, "fault": fault})


def features(bars: DataFrame, named: dict[str, Column]) -> DataFrame:
    """``bars`` with the named feature columns; names that the bars have, or that differ only by case, raise ``ValueError``."""
    taken = [c.lower() for c in (*bars.columns, *named)]
    if len(set(taken)) < len(taken):
        raise ValueError("feature names must be new")
    return bars.withColumns(named)


def replay(windows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The stretches that end at each of ``cutoffs(symbol, end_ts)``: what was current there, since no stretch sees later bars."""
    return windows.join(cutoffs.select("symbol", "end_ts").distinct(), ["symbol", "end_ts"], "left_semi")
