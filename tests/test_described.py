"""Descriptions that travel with columns, and bracket strategies by name."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.functions import described
from barspark.functions import indicators as ind
from barspark.plans import strategies
from barspark.plans.pipeline import Contract, Pipeline, registry

BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    close = 50 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.02, 80)))
    at = datetime.datetime(2024, 1, 2)
    return ind.numbered(spark.createDataFrame([("A", at + datetime.timedelta(hours=k), float(c), float(c * 1.01), float(c * 0.99), float(c), 1.0) for k, c in enumerate(close)], BARS))


@pytest.mark.parametrize("name", sorted(described.DESCRIBED))
def test_warm_up_is_what_the_column_says(bars, name):
    df = described.with_indicator(bars, name)
    told = described.facts(df)
    assert set(told) == set(described.DESCRIBED[name].units)
    for column, fact in told.items():
        first = df.where(F.col(column).isNotNull()).agg(F.min("rn")).first()[0]
        assert first == fact["warm_up"] + 1 and fact["unit"] and fact["causal"] and fact["indicator"] == name
    assert described.facts(df.where("rn > 3").select("rn", *told).join(bars.select("rn", "close"), "rn")) == told
    assert described.warmed(df).agg(F.min("rn")).first()[0] == described.warm_up(df) + 1


def test_table_and_bad_names(spark, bars):
    table = described.indicator_table(spark).collect()
    assert {(r.indicator, r.column) for r in table} == {(n, c) for n, d in described.DESCRIBED.items() for c in d.units}
    assert {r.column: r.warm_up for r in table}["adx"] == 27
    for name, parameters in (("none", {}), ("rsi", {"length": 3}), ("rsi", {"period": 0})):
        with pytest.raises(ValueError):
            described.with_indicator(bars, name, **parameters)


def test_a_backtest_refuses_what_looks_ahead(bars):
    good = registry.load('[{"name": "indicator", "config": {"indicator": "rsi", "period": 5}}]')
    out, contract = good.run(bars, Contract("1h"), backtest=True)
    assert "rsi" in out.columns and contract.causal
    late = Pipeline([*good.steps, registry.build("next_return", bars=2)])
    assert late.run(bars, Contract("1h"))[1].causal is False
    with pytest.raises(ValueError, match="next_return looks ahead"):
        late.run(bars, Contract("1h"), backtest=True)
    with pytest.raises(ValueError, match="label"):
        good.run(described.ahead(bars, "label", F.lead("close").over(ind.by_time())), Contract("1h"), backtest=True)


def test_bracket_strategies(bars):
    spec = {"name": "every_bar", "config": {"win": 1.03, "stop": 0.98}}
    found = strategies.outcomes_of(bars, spec).collect()
    rows = {r.rn: r for r in bars.collect()}
    assert len(found) == 79
    for r in found:
        entry = rows[r.rn + 1].open
        up, down = (entry * 1.03, entry * 0.98) if r.direction == "long" else (entry / 0.98, entry / 1.03)
        hit = next((k for k in range(r.rn + 1, 81) if rows[k].high > up or rows[k].low < down), None)
        assert r.hit == hit
    crossing = strategies.outcomes_of(bars, {"name": "average_crossing", "config": {"fast": 3, "slow": 8, "win": 1.03, "stop": 0.98}}).collect()
    assert crossing and {r.direction for r in crossing} == {"long"}
    for config in ({"win": 0.9, "stop": 0.5}, {"win": 1.1}, {"win": 1.1, "stop": 0.9, "more": 1}):
        with pytest.raises(ValueError):
            strategies.outcomes_of(bars, {"name": "every_bar", "config": config})
