"""Bars of a stream of trades, closed by a watermark: the stream form of the completed-bar rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(trades: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """``trades(symbol, ts, sequence, price, size)`` to bars; in append mode a bar comes out once, when no trade can still reach it."""
    key = F.struct("ts", "sequence")
    found = trades.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "symbol").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("size").alias("volume")
    )
    return found.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
