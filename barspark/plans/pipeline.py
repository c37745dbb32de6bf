"""Pipelines of named, versioned steps with a contract that travels with the bars."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.functions.described import ahead, refuse_lookahead, with_indicator
from barspark.functions.indicators import by_time, numbered
from barspark.operators import actions, resample, validate


@dataclass(frozen=True)
class Contract:
    timeframe: str
    convention: str = "bar_start"
    source_basis: str = "unadjusted"
    adjusted: bool = False
    causal: bool = True


@dataclass(frozen=True)
class Step:
    name: str
    version: str
    config: tuple[tuple[str, object], ...]
    run: Callable[[DataFrame], DataFrame]
    after: Callable[[Contract], Contract] = lambda c: c

    def described(self) -> dict:
        return {"name": self.name, "version": self.version, "config": dict(self.config)}


class Registry:
    """Step builders by exact name and version."""

    def __init__(self):
        self.builders: dict[tuple[str, str], Callable[..., Step]] = {}

    def add(self, name: str, version: str = "1"):
        def register(f):
            if (name, version) in self.builders:
                raise ValueError(f"{name} {version} is there already")
            self.builders[name, version] = lambda **config: replace(f(**config), name=name, version=version, config=tuple(sorted((k, v) for k, v in config.items() if isinstance(v, (str, int, float, bool, type(None))))))
            return f

        return register

    def build(self, name: str, version: str = "1", **config) -> Step:
        if (name, version) not in self.builders:
            raise ValueError(f"no step {name} {version}")
        return self.builders[name, version](**config)

    def load(self, recipe: str, **tables: DataFrame) -> Pipeline:
        """A JSON list of ``{name, version, config}``; a config value ``"$x"`` stands for the table ``x``."""
        steps = []
        for item in json.loads(recipe):
            config = {k: tables[v[1:]] if isinstance(v, str) and v.startswith("$") else v for k, v in item.get("config", {}).items()}
            steps.append(self.build(item["name"], item.get("version", "1"), **config))
        return Pipeline(steps)


class Pipeline:
    """Steps in order; one lazy plan over all symbols."""

    def __init__(self, steps: list[Step]):
        self.steps = steps

    def fingerprint(self) -> str:
        text = json.dumps([s.described() for s in self.steps], sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()

    def run(self, bars: DataFrame, contract: Contract, backtest: bool = False) -> tuple[DataFrame, Contract]:
        """Bars after all steps, and their contract. In a ``backtest`` a step or a column that looks at later bars raises ``ValueError`` before anything runs."""
        for step in self.steps:
            contract = step.after(contract)
            bars = bars.transform(step.run)
            if backtest and not contract.causal:
                raise ValueError(f"the step {step.name} looks ahead")
        return (refuse_lookahead(bars) if backtest else bars), contract


def preview(pipeline: Pipeline, bars: DataFrame, contract: Contract, rows: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first ``rows`` bars by symbol and time before and after a pipeline."""
    first = lambda df: df.orderBy("symbol", "ts").limit(rows)
    return first(bars), first(pipeline.run(bars, contract)[0])


def by_ticker(pipeline: Pipeline, bars: DataFrame, contract: Contract, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The output of a pipeline over all tickers at once, and of each of ``requested(symbol)`` the bars in and out with ``status``: done, empty or no data."""
    out, _ = pipeline.run(bars, contract)
    count = lambda df, name: df.groupBy("symbol").agg(F.count("*").alias(name))
    rows = requested.select("symbol").distinct().join(count(bars, "bars_in"), "symbol", "left").join(count(out, "bars_out"), "symbol", "left").na.fill(0, ["bars_in", "bars_out"])
    return out, rows.withColumn("status", F.when(F.col("bars_in") == 0, "no data").when(F.col("bars_out") == 0, "empty").otherwise("done"))


registry = Registry()


def step(run: Callable[[DataFrame], DataFrame], after: Callable[[Contract], Contract] = lambda c: c) -> Step:
    return Step("", "", (), run, after)


@registry.add("scale_prices")
def _scale(factor: float) -> Step:
    return step(lambda b: validate.scale_prices(b, factor))


@registry.add("clock_window")
def _clock(start: str, end: str, tz: str = "UTC") -> Step:
    return step(lambda b: validate.clock_window(b, start, end, tz))


@registry.add("resample_sessions")
def _resample(sessions: DataFrame, minutes: int | None, source_minutes: int, incomplete: str = "drop") -> Step:
    def after(c: Contract) -> Contract:
        if c.convention != "bar_start":
            raise ValueError("sessions need bars by their start")
        return replace(c, timeframe=f"{minutes}m" if minutes else "1d", convention="bar_start" if minutes else "session_label")

    return step(lambda b: resample.resample_sessions(b, sessions, minutes, source_minutes, incomplete).drop("label", "expected", "observed"), after)


@registry.add("adjust_actions")
def _adjust(events: DataFrame, reference_date: str) -> Step:
    def after(c: Contract) -> Contract:
        if c.adjusted or c.source_basis != "unadjusted":
            raise ValueError("the bars are adjusted already")
        return replace(c, adjusted=True)

    def run(b: DataFrame) -> DataFrame:
        good = actions.event_factors(events).where("fault is null")
        return actions.adjust(b, actions.relevant(good, b, reference_date))

    return step(run, after)


@registry.add("indicator")
def _indicator(indicator: str, **parameters: int) -> Step:
    return step(lambda b: with_indicator(b if "rn" in b.columns else numbered(b), indicator, **parameters))


@registry.add("next_return")
def _next_return(bars: int = 1) -> Step:
    """The return to the close ``bars`` later: a label, which no backtest may see."""
    return step(lambda b: ahead(b, "next_return", F.try_divide(F.lead("close", bars).over(by_time()), F.col("close")) - 1), lambda c: replace(c, causal=False))
