"""Bars from event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.schema import utc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of positive event values by type: first, greatest, least, last and number in each ``unit``."""
    rows = read(spark, sf_dir, "events").where("value > 0").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), "event_id", "value")
    key = F.struct("at", "event_id")
    return rows.groupBy("symbol", F.date_trunc(unit, "at").alias("ts")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").cast("double").alias("volume")
    )


def ship_bars(spark: SparkSession, sf_dir: str, unit: str = "day", by_brand: bool = False) -> DataFrame:
    """Bars of unit prices by shipping date, of return flag and status or of brand."""
    rows = read(spark, sf_dir, "lineitem")
    if by_brand:
        rows = rows.join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    symbol = F.col("p_brand") if by_brand else F.concat("l_returnflag", "l_linestatus")
    rows = rows.select(symbol.alias("symbol"), F.date_trunc(unit, F.col("l_shipdate").cast("timestamp")).alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("key"))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "key").alias("close"), F.sum("l_quantity").alias("volume")
    )
