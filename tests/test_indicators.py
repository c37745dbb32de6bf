"""Indicators against written-out loops, and their prefixes."""

import datetime

import numpy as np
import pytest

from barspark.functions import indicators as ind
from barspark.operators import strategy

START = datetime.datetime(2024, 1, 2, 14)


def series(n, seed=42):
    rng = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * (1 + rng.normal(0, 0.01, n))
    high, low = np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99
    return open_, high, low, close, rng.integers(0, 9, n).astype(float)


def frame(spark, n=700, symbols=("A", "B")):
    rows = []
    for k, s in enumerate(symbols):
        for i, v in enumerate(zip(*series(n, 42 + k))):
            rows.append((s, START + datetime.timedelta(hours=i), *map(float, v)))
    return ind.numbered(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double"))


def values(df, name, symbol="A"):
    return [np.nan if r[0] is None else r[0] for r in df.where(f"symbol = '{symbol}'").orderBy("ts").select(name).collect()]


def smoothed(x, start, keep, seed, weight):
    out = np.full(len(x), np.nan)
    y = seed
    out[start] = y
    for i in range(start + 1, len(x)):
        y = keep * y + weight * x[i]
        out[i] = y
    return out


@pytest.mark.parametrize("period", [2, 3, 14, 200])
def test_ema(spark, period):
    close = series(700)[3]
    want = smoothed(close, period - 1, 1 - 2 / (period + 1), close[:period].mean(), 2 / (period + 1))
    np.testing.assert_allclose(values(ind.ema(frame(spark), period), "ema"), want, rtol=1e-10)


def test_rsi_and_atr(spark):
    _, high, low, close, _ = series(700)
    p, d = 14, np.diff(close, prepend=np.nan)
    up = smoothed(np.maximum(d, 0), p, 1 - 1 / p, np.maximum(d, 0)[1 : p + 1].mean(), 1 / p)
    down = smoothed(np.maximum(-d, 0), p, 1 - 1 / p, np.maximum(-d, 0)[1 : p + 1].mean(), 1 / p)
    np.testing.assert_allclose(values(ind.rsi(frame(spark), p), "rsi"), 100 * up / (up + down), rtol=1e-10)
    before = np.concatenate([[np.nan], close[:-1]])
    tr = np.fmax(high - low, np.fmax(abs(high - before), abs(low - before)))
    np.testing.assert_allclose(values(ind.atr(frame(spark), p), "atr"), smoothed(tr, p, 1 - 1 / p, tr[1 : p + 1].mean(), 1 / p), rtol=1e-10)


def test_flat_series(spark):
    rows = [("A", START + datetime.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(60)]
    df = ind.numbered(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double"))
    assert values(ind.rsi(df, 14), "rsi")[14:] == [0.0] * 46
    assert values(ind.stochastic(df), "slow_k")[-1] == 0.0
    assert values(ind.with_obv(df), "obv")[-1] == 1.0


@pytest.mark.parametrize("make", [lambda d: ind.macd(d), lambda d: ind.adx(d), lambda d: ind.stochastic(d), lambda d: ind.with_obv(d), lambda d: d.withColumn("wma", ind.wma("close", 9)), lambda d: strategy.factor_panel(d.drop("rn"), 8)])
def test_later_bars_change_nothing(spark, make):
    df = frame(spark, 300)
    whole, part = make(df), make(df.where("rn <= 200"))
    names = [c for c in part.columns if c not in ("symbol", "ts")]
    a = whole.where("rn <= 200").orderBy("symbol", "ts").select(*names).toPandas()
    b = part.orderBy("symbol", "ts").select(*names).toPandas()
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-12)


def test_warm_up(spark):
    df = frame(spark, 100, ("A",))
    found = {"macd": (ind.macd(df), (12, 26, 9)), "adx": (ind.adx(df), (14,)), "rsi": (ind.rsi(df), (14,)), "atr": (ind.atr(df), (14,))}
    for name, (got, args) in found.items():
        assert np.isnan(values(got, name)).sum() == ind.WARM_UP[name](*args)


@pytest.mark.parametrize("period", [2000, 4000])
def test_long_periods_equal_a_loop(spark, period):
    n = 12_000
    _, _, _, close, _ = series(n)
    rows = [("A", START + datetime.timedelta(hours=i), float(c)) for i, c in enumerate(close)]
    df = ind.numbered(spark.createDataFrame(rows, "symbol string, ts timestamp, close double"))
    want = smoothed(close, period - 1, 1 - 2 / (period + 1), close[:period].mean(), 2 / (period + 1))
    np.testing.assert_allclose(values(ind.ema(df, period), "ema"), want, rtol=1e-9)
    want = smoothed(close, period - 1, 1 - 1 / period, close[:period].mean(), 1 / period)
    np.testing.assert_allclose(values(ind.wilder(df, {"w": "close"}, period, period), "w"), want, rtol=1e-9)


def test_scans_join_nothing(spark):
    plan = ind.adx(frame(spark, 100))._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
