"""Strategies and portfolio policies by name and version, from specifications of plain data.

A strategy takes numbered bars and returns a column of target weights, from 0 to 1; a policy takes
the scored rows of each time and returns them with ``proposed``, their weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions import indicators as ind
from barspark.operators import strategy
from barspark.schema import by_time, ratio, true


class Named:
    """Builders by exact name and version."""

    def __init__(self, kind: str):
        self.kind, self.builders = kind, {}

    def add(self, name: str, version: str = "1"):
        def register(f):
            if (name, version) in self.builders:
                raise ValueError(f"{self.kind} {name} {version} is there already")
            self.builders[name, version] = f
            return f

        return register

    def load(self, spec: dict):
        """What ``{name, version, config}`` stands for; other keys, names and configurations raise ``ValueError``."""
        if not isinstance(spec, dict) or not {"name"} <= set(spec) <= {"name", "version", "config"}:
            raise ValueError(f"a {self.kind} has a name, a version and a config")
        key = spec["name"], spec.get("version", "1")
        if key not in self.builders:
            raise ValueError(f"no {self.kind} {key[0]} {key[1]}")
        try:
            return self.builders[key](**spec.get("config", {}))
        except TypeError as e:
            raise ValueError(f"{self.kind} {key[0]}: {e}") from e


Strategy = Callable[[], Column]
#: Numbered bars to the same with ``entry`` and ``direction``, and the bounds of a win and of a stop as parts of the entry price.
Bracket = Callable[[DataFrame], DataFrame]
strategies, policies, brackets = Named("strategy"), Named("policy"), Named("bracket strategy")


@strategies.add("average_crossing")
def _crossing(fast: int, slow: int, price: str = "close") -> Strategy:
    if not 0 < fast < slow:
        raise ValueError("the fast average must be the shorter one")
    return lambda: F.when(true(ind.sma(price, fast) > ind.sma(price, slow)), 1.0).otherwise(0.0)


@strategies.add("momentum")
def _momentum(lookback: int) -> Strategy:
    return lambda: F.when(true(F.col("close") > F.lag("close", lookback).over(by_time())), 1.0).otherwise(0.0)


@strategies.add("weighted")
def _weighted(parts: list[dict], weights: list[float]) -> Strategy:
    """A blend of strategies; the weights are positive and sum to 1."""
    if len(parts) != len(weights) or not parts or min(weights) <= 0 or abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights must be positive, one a part, and sum to 1")
    built = [strategies.load(x) for x in parts]
    return lambda: F.least(F.lit(1.0), sum((w * f() for w, f in zip(weights[1:], built[1:])), weights[0] * built[0]()))


def weights_of(bars: DataFrame, spec: dict, name: str = "weight") -> DataFrame:
    """Numbered ``bars`` with the target weights of a strategy; what is not from 0 to 1 becomes 0 or 1, null 0."""
    return bars.withColumn(name, F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), strategies.load(spec)())), F.lit(0.0)))


@policies.add("top_n_equal")
def _equal(n: int) -> Callable[[DataFrame], DataFrame]:
    def propose(panel: DataFrame) -> DataFrame:
        chosen = strategy.top_n(panel, n)
        return chosen.withColumn("proposed", 1.0 / F.count("*").over(Window.partitionBy("ts")))

    return propose


@policies.add("top_n_score")
def _score(n: int) -> Callable[[DataFrame], DataFrame]:
    def propose(panel: DataFrame) -> DataFrame:
        chosen = strategy.top_n(panel, n).where("score > 0")
        return chosen.withColumn("proposed", ratio(F.col("score"), F.sum("score").over(Window.partitionBy("ts"))))

    return propose


@policies.add("inverse_volatility")
def _inverse(n: int) -> Callable[[DataFrame], DataFrame]:
    def propose(panel: DataFrame) -> DataFrame:
        chosen = strategy.top_n(panel.where("volatility > 0"), n)
        part = 1 / F.col("volatility")
        return chosen.withColumn("proposed", part / F.sum(part).over(Window.partitionBy("ts")))

    return propose


def _bounds(win: float, stop: float) -> None:
    if not 0 < stop < 1 < win:
        raise ValueError("a stop is under and a win over 1")


@brackets.add("every_bar")
def _every_bar(win: float, stop: float) -> Bracket:
    """Each bar is an entry, against a falling one short."""
    _bounds(win, stop)
    side = F.when(F.col("close") < F.col("open"), "short").otherwise("long")
    return lambda bars: bars.withColumns({"signal": F.lit(True), "side": side, "win": F.lit(win), "stop": F.lit(stop)})


@brackets.add("average_crossing")
def _average_crossing(fast: int, slow: int, win: float, stop: float, shorts: bool = False) -> Bracket:
    """Long where the fast average crosses above the slow one, and with ``shorts`` short where it crosses below."""
    _bounds(win, stop)
    if not 0 < fast < slow:
        raise ValueError("the fast average must be the shorter one")

    def prepare(bars: DataFrame) -> DataFrame:
        bars = bars.withColumns({"_fast": ind.sma("close", fast), "_slow": ind.sma("close", slow)})
        up, down = ind.crossed_above("_fast", "_slow"), ind.crossed_below("_fast", "_slow") & F.lit(shorts)
        return bars.withColumns({"signal": up | down, "side": F.when(up, "long").otherwise("short"), "win": F.lit(win), "stop": F.lit(stop)}).drop("_fast", "_slow")

    return prepare


def outcomes_of(bars: DataFrame, spec: dict) -> DataFrame:
    """The outcomes of a bracket strategy by name over numbered ``bars``: prepared signals, entries at the next open, first bound hit."""
    prepared = brackets.load(spec)(bars)
    config = spec.get("config", {})
    return strategy.bracket_outcomes(prepared, F.col("signal"), config["win"], config["stop"], F.col("side")).drop("signal", "side", "win", "stop")
