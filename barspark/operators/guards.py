"""Rules that stop a job from inside its plan: a bad row raises while it is computed, with no job of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stopped(df: DataFrame, bad: Column, message: Column | str, on: str) -> DataFrame:
    """``df``, whose column ``on`` raises ``message`` where ``bad`` holds. Take a column that every use of ``df`` reads."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.withColumn(on, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(text)).otherwise(F.col(on)))


def stopped_by(df: DataFrame, faults: DataFrame, message: str, on: str) -> DataFrame:
    """``df``, which raises if ``faults``, a table to be counted in the same job, has a row."""
    count = faults.agg(F.count("*").alias("_faults"))
    return stopped(df.crossJoin(F.broadcast(count)), F.col("_faults") > 0, message, on).drop("_faults")  # one row


def scans(df: DataFrame) -> int:
    """How often the plan of ``df`` reads files."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("FileScan") + text.count("BatchScan")
