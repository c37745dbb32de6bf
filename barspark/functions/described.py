"""Indicators by name, whose columns tell in their metadata what they are: unit, inputs, parameters, warm-up and causality.

Metadata of a column is kept by projections, filters and joins, so what a plan was made of can be
read back from its schema: how many rows it needs before its first value, and whether it looks ahead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions import indicators as ind


@dataclass(frozen=True)
class Described:
    units: dict[str, str]
    inputs: tuple[str, ...]
    defaults: dict[str, int]
    warm_up: Callable[..., dict[str, int]]
    build: Callable[..., DataFrame]


def _all(names: dict[str, str], rows: int) -> dict[str, int]:
    return dict.fromkeys(names, rows)


def _column(name: str, make: Callable[..., Column]) -> Callable[..., DataFrame]:
    return lambda df, **p: df.withColumn(name, make(**p))


_BANDS = {"upper": "price", "middle": "price", "lower": "price"}
DESCRIBED = {
    "sma": Described({"sma": "price"}, ("close",), {"period": 20}, lambda period: {"sma": period - 1}, _column("sma", lambda period: ind.sma("close", period))),
    "wma": Described({"wma": "price"}, ("close",), {"period": 20}, lambda period: {"wma": period - 1}, _column("wma", lambda period: ind.wma("close", period))),
    "ema": Described({"ema": "price"}, ("close",), {"period": 20}, lambda period: {"ema": period - 1}, lambda df, period: ind.ema(df, period)),
    "rsi": Described({"rsi": "0 to 100"}, ("close",), {"period": 14}, lambda period: {"rsi": period}, lambda df, period: ind.rsi(df, period)),
    "macd": Described(
        {"macd": "price", "macd_signal": "price", "macd_histogram": "price"}, ("close",), {"fast": 12, "slow": 26, "signal": 9},
        lambda fast, slow, signal: _all({"macd": "", "macd_signal": "", "macd_histogram": ""}, max(fast, slow) + signal - 2), lambda df, **p: ind.macd(df, **p),
    ),
    "atr": Described({"atr": "price", "natr": "percent of close"}, ("high", "low", "close"), {"period": 14}, lambda period: {"atr": period, "natr": period}, lambda df, period: ind.atr(df, period)),
    "adx": Described({"plus_di": "0 to 100", "minus_di": "0 to 100", "adx": "0 to 100"}, ("high", "low", "close"), {"period": 14}, lambda period: {"plus_di": period, "minus_di": period, "adx": 2 * period - 1}, lambda df, period: ind.adx(df, period)),
    "stochastic": Described({"slow_k": "0 to 100", "slow_d": "0 to 100"}, ("high", "low", "close"), {"period": 14, "smoothing": 3, "signal": 3}, lambda period, smoothing, signal: _all({"slow_k": "", "slow_d": ""}, period + smoothing + signal - 3), lambda df, **p: ind.stochastic(df, **p)),
    "obv": Described({"obv": "volume"}, ("close", "volume"), {}, lambda: {"obv": 0}, lambda df: ind.with_obv(df)),
}


def tagged(df: DataFrame, column: str, **facts) -> DataFrame:
    """``df`` with ``facts`` in the metadata of ``column``, beside those that it has."""
    return df.withColumn(column, F.col(column).alias(column, metadata=dict(df.schema[column].metadata, **facts)))


def with_indicator(df: DataFrame, name: str, **parameters) -> DataFrame:
    """Numbered bars with the columns of an indicator and their description; an unknown name or parameter raises ``ValueError``."""
    if name not in DESCRIBED:
        raise ValueError(f"no indicator {name}")
    known = DESCRIBED[name]
    if odd := set(parameters) - set(known.defaults):
        raise ValueError(f"{name} has no {sorted(odd)}")
    used = known.defaults | parameters
    if not all(isinstance(v, int) and v > 0 for v in used.values()):
        raise ValueError("parameters are whole and positive")
    out, warm_up = known.build(df, **used), known.warm_up(**used)
    for column, unit in known.units.items():
        out = tagged(out, column, indicator=name, unit=unit, inputs=list(known.inputs), parameters=used, warm_up=warm_up[column], causal=True)
    return out


def ahead(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that looks at later bars, and says so: a label, not a feature."""
    return tagged(df.withColumn(name, value), name, causal=False)


def facts(df: DataFrame) -> dict[str, dict]:
    """What the described columns of ``df`` say of themselves."""
    return {f.name: dict(f.metadata) for f in df.schema if "causal" in f.metadata}


def warm_up(df: DataFrame) -> int:
    """The rows of a symbol before all described columns have a value."""
    return max([f.get("warm_up", 0) for f in facts(df).values()], default=0)


def warmed(df: DataFrame) -> DataFrame:
    """Numbered rows behind the longest warm-up of the described columns."""
    return df.where(F.col("rn") > warm_up(df))


def refuse_lookahead(df: DataFrame) -> DataFrame:
    """``df``; a column that looks ahead raises ``ValueError``."""
    if late := sorted(n for n, f in facts(df).items() if not f["causal"]):
        raise ValueError(f"columns that look ahead: {late}")
    return df


def indicator_table(spark: SparkSession) -> DataFrame:
    """A row a column of each indicator, with its unit, its inputs, and the warm-up at the default parameters."""
    rows = [(n, c, unit, list(d.inputs), {k: int(v) for k, v in d.defaults.items()}, d.warm_up(**d.defaults)[c]) for n, d in DESCRIBED.items() for c, unit in d.units.items()]
    return spark.createDataFrame(rows, "indicator string, column string, unit string, inputs array<string>, parameters map<string, int>, warm_up int")
