"""Technical indicators: bars to bars with further columns, null in the warm-up."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.schema import by_time, ratio, true


def last_rows(n: int, *keys: str):
    return by_time(*keys).rowsBetween(1 - n, 0)


def numbered(bars: DataFrame) -> DataFrame:
    """``bars`` with ``rn``, from 1 in each symbol."""
    return bars.withColumn("rn", F.row_number().over(by_time()))


def from_row(first: int, value: Column) -> Column:
    return F.when(F.col("rn") >= first, value)


def sma(price: Column | str, period: int) -> Column:
    return from_row(period, F.avg(price).over(last_rows(period)))


def wma(price: str, period: int) -> Column:
    """Weights 1 to ``period``, the newest heaviest."""
    w = last_rows(period)
    total = F.sum(F.col("rn") * F.col(price)).over(w) - (F.col("rn") - period) * F.sum(price).over(w)
    return from_row(period, total / (period * (period + 1) / 2))


def affine_scans(df: DataFrame, start: int, keep: float, values: dict[str, Column]) -> DataFrame:
    """``df`` with a column per name: y(start) = value, then y(t) = keep * y(t - 1) + value; null before row ``start``.

    Blocks are of such a length that ``keep`` to its power is about 1e-12, however long that is:
    within a block y is a weighted running sum, and of what comes before only the last two
    blocks are felt. All names, and their blocks, share one sort of the symbol's partition.
    """
    block = max(1, int(math.log(1e-12) / math.log(keep))) if 0 < keep < 1 else 1
    k = F.col("rn") - start
    df = df.withColumns({"_block": F.floor(k / block), "_k": F.pmod(k, F.lit(block))} | {f"_v{i}": F.when(k >= 0, v) for i, v in enumerate(values.values())})
    parts = range(len(values))
    if keep == 0:
        return df.withColumns({name: F.col(f"_v{i}") for i, name in enumerate(values)}).drop("_block", "_k", *[f"_v{i}" for i in parts])
    own = Window.partitionBy("symbol", "_block").orderBy("rn")
    before = Window.partitionBy("symbol").orderBy("_block", "rn").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.pow(F.lit(keep), -F.col("_k"))
    df = df.withColumns({f"_l{i}": F.pow(F.lit(keep), "_k") * F.sum(F.col(f"_v{i}") * weight).over(own) for i in parts})
    at_end = (F.col("_k") == block - 1) & (F.col("_block") >= 0)

    def last_end(i: int) -> Column:
        return F.coalesce(F.last(F.when(at_end, F.col(f"_l{i}")), ignorenulls=True).over(before), F.lit(0.0))

    df = df.withColumns({f"_b{i}": last_end(i) for i in parts})
    # an end with what it takes over from the block before it
    df = df.withColumns({f"_l{i}": F.when(at_end, F.col(f"_l{i}") + keep**block * F.col(f"_b{i}")).otherwise(F.col(f"_l{i}")) for i in parts})
    df = df.withColumns({f"_c{i}": last_end(i) for i in parts})
    y = [F.when(at_end, F.col(f"_l{i}") - keep**block * F.col(f"_b{i}")).otherwise(F.col(f"_l{i}")) + F.pow(F.lit(keep), F.col("_k") + 1) * F.col(f"_c{i}") for i in parts]
    df = df.withColumns({name: F.when(F.col("rn") >= start, y[i]) for i, name in enumerate(values)})
    return df.drop("_block", "_k", *[f"_{x}{i}" for i in parts for x in "vlbc"])


def affine_scan(df: DataFrame, start: int, keep: float, value: Column, name: str) -> DataFrame:
    return affine_scans(df, start, keep, {name: value})


def ema(bars: DataFrame, period: int, price: str = "close", name: str = "ema", seed_row: int | None = None) -> DataFrame:
    """Seeded with the mean of the ``period`` rows that end at the seed row."""
    first, alpha = seed_row or period, 2 / (period + 1)
    value = F.when(F.col("rn") == first, F.avg(price).over(last_rows(period))).otherwise(alpha * F.col(price))
    return affine_scan(bars, first, 1 - alpha, value, name)


def wilder(bars: DataFrame, names: dict[str, str], first: int, period: int) -> DataFrame:
    """For each name the mean of ``period`` values of a column up to row ``first``, then Wilder's smoothing."""
    value = lambda x: F.when(F.col("rn") == first, F.avg(x).over(last_rows(period))).otherwise(F.col(x) / period)
    return affine_scans(bars, first, 1 - 1 / period, {name: value(x) for name, x in names.items()})


def rsi(bars: DataFrame, period: int = 14, price: str = "close") -> DataFrame:
    change = F.col(price) - F.lag(price).over(by_time())
    df = bars.withColumns({"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))})
    df = wilder(df, {"_up": "_gain", "_down": "_loss"}, period + 1, period)
    both = F.col("_up") + F.col("_down")
    return df.withColumn("rsi", F.when(both == 0, 0.0).otherwise(100 * ratio(F.col("_up"), both))).drop("_gain", "_loss", "_up", "_down")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close") -> DataFrame:
    df = ema(ema(bars, fast, price, "_fast", slow), slow, price, "_slow")
    df = df.withColumn("_line", F.col("_fast") - F.col("_slow"))
    df = ema(df, signal, "_line", "_signal", slow + signal - 1)
    first = slow + signal - 1
    line = from_row(first, F.col("_line"))
    return df.withColumns({"macd": line, "macd_signal": F.col("_signal"), "macd_histogram": line - F.col("_signal")}).drop("_fast", "_slow", "_line", "_signal")


def true_range() -> Column:
    before = F.lag("close").over(by_time())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """``atr`` and ``natr``, its percentage of the close (0 for a zero close)."""
    df = wilder(bars.withColumn("_range", true_range()), {"atr": "_range"}, period + 1, period).drop("_range")
    return df.withColumn("natr", F.when(F.col("atr").isNotNull(), F.coalesce(100 * ratio(F.col("atr"), F.col("close")), F.lit(0.0))))


def bollinger(price: str, period: int, up: float = 2.0, down: float = 2.0) -> dict[str, Column]:
    w = last_rows(period)
    middle, spread = F.avg(price).over(w), F.stddev_pop(price).over(w)
    return {"band_upper": from_row(period, middle + up * spread), "band_middle": from_row(period, middle), "band_lower": from_row(period, middle - down * spread)}


def adx(bars: DataFrame, period: int = 14) -> DataFrame:
    """``plus_di`` and ``minus_di`` from row period + 1, ``adx`` from row 2 * period.

    Wilder's sums start with the first period - 1 moves and go on as S - S / period + x.
    """
    w = by_time()
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    df = bars.withColumns({
        "_plus": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
        "_minus": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
        "_range": true_range(),
    })
    keep = 1 - 1 / period
    value = lambda x: F.when(F.col("rn") == period, F.coalesce(F.sum(x).over(last_rows(period)), F.lit(0.0))).otherwise(F.col(x))
    df = affine_scans(df, period, keep, {f"{x}_sum": value(x) for x in ("_plus", "_minus", "_range")})
    share = lambda x: from_row(period + 1, F.coalesce(100 * ratio(F.col(x), F.col("_range_sum")), F.lit(0.0)))
    df = df.withColumns({"plus_di": share("_plus_sum"), "minus_di": share("_minus_sum")})
    dx = F.coalesce(100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")), F.lit(0.0))
    df = wilder(df.withColumn("_dx", from_row(period + 1, dx)), {"adx": "_dx"}, 2 * period, period)
    return df.drop("_plus", "_minus", "_range", "_plus_sum", "_minus_sum", "_range_sum", "_dx")


def stochastic(bars: DataFrame, period: int = 14, smoothing: int = 3, signal: int = 3) -> DataFrame:
    """``slow_k`` and ``slow_d`` from their shared warm-up on; a zero range gives 0."""
    w = last_rows(period)
    low, high = F.min("low").over(w), F.max("high").over(w)
    df = bars.withColumn("_k", F.coalesce(100 * ratio(F.col("close") - low, high - low), F.lit(0.0)))
    df = df.withColumn("_slow", F.avg("_k").over(last_rows(smoothing)))
    first = period + smoothing + signal - 2
    return df.withColumns({"slow_k": from_row(first, F.col("_slow")), "slow_d": from_row(first, F.avg("_slow").over(last_rows(signal)))}).drop("_k", "_slow")


def obv(price: str = "close") -> tuple[Column, Column]:
    """The signed volume of a bar (the first counts in full), and the column that sums it."""
    step = F.signum(F.col(price) - F.lag(price).over(by_time()))
    return F.coalesce(step, F.lit(1.0)) * F.col("volume"), F.sum("_signed").over(by_time().rowsBetween(Window.unboundedPreceding, 0))


def with_obv(bars: DataFrame, price: str = "close") -> DataFrame:
    signed, total = obv(price)
    return bars.withColumn("_signed", signed).withColumn("obv", total).drop("_signed")


def momentum(lookback: int) -> Column:
    return ratio(F.col("close"), F.lag("close", lookback).over(by_time())) - 1


def with_volatility(bars: DataFrame, lookback: int, name: str = "volatility") -> DataFrame:
    """The population deviation of ``lookback`` one-bar returns."""
    df = bars.withColumn("_r", ratio(F.col("close"), F.lag("close").over(by_time())) - 1)
    return df.withColumn(name, from_row(lookback + 1, F.stddev_pop("_r").over(last_rows(lookback)))).drop("_r")


def red_bar_high(lookback: int) -> Column:
    """The mean of (high - open) / high over the red bars among the last ``lookback``; null without one."""
    red = F.when(F.col("close") < F.col("open"), ratio(F.col("high") - F.col("open"), F.col("high")))
    return from_row(lookback, F.avg(red).over(last_rows(lookback)))


def crossed_above(left: str, right: str) -> Column:
    w = by_time()
    return true((F.col(left) > F.col(right)) & (F.lag(left).over(w) <= F.lag(right).over(w)))


def crossed_below(left: str, right: str) -> Column:
    return crossed_above(right, left)


#: Rows before the first value of each indicator, by its parameters.
WARM_UP = {
    "sma": lambda period: period - 1, "wma": lambda period: period - 1, "ema": lambda period: period - 1, "rsi": lambda period: period,
    "macd": lambda fast, slow, signal: slow + signal - 2, "atr": lambda period: period, "bollinger": lambda period: period - 1,
    "adx": lambda period: 2 * period - 1, "stochastic": lambda period, smoothing, signal: period + smoothing + signal - 3, "obv": lambda: 0,
}
