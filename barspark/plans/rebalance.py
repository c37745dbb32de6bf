"""From scores to a decision table: schedule, eligible panel, policy and holdings as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators import strategy
from barspark.plans.strategies import policies

KINDS = ("every_n", "daily", "weekly", "monthly")


def rebalances(closes: DataFrame, kind: str = "every_n", every: int = 1, tz: str = "UTC") -> DataFrame:
    """``(rebalance_id, ts)`` of the bar times ``closes(ts)`` that are rebalances, in order."""
    if kind not in KINDS:
        raise ValueError(f"the kind is one of {KINDS}")
    due = strategy.schedule(closes.select("ts").distinct(), every, tz).where(kind)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts"))  # a row a rebalance
    return due.select(F.concat(F.lit("rebalance-"), F.lpad(number.cast("string"), 6, "0")).alias("rebalance_id"), "ts")


def decisions(panel: DataFrame, due: DataFrame, policy: dict, held: DataFrame, lookback: int = 1, starts: DataFrame | None = None, **limits: float) -> DataFrame:
    """The decision table of each rebalance of ``due(rebalance_id, ts)``.

    ``panel(symbol, ts, score, ...)`` counts observations up to each row; rows with fewer than ``lookback``, or before their symbol's start, have no score. The
    ``policy``, by name, proposes weights among the scored ones. ``held(ts, symbol, current)`` is the state, keyed by the
    time of the rebalance: a later rebalance does not look at an earlier one, so all are decided in one job. What is held without a score is
    frozen. ``limits`` are those of :func:`barspark.operators.strategy.rebalance_targets`.
    """
    scored = strategy.eligible(panel, lookback, starts).join(due.select("ts"), "ts", "left_semi").where("score is not null")
    proposed = policies.load(policy)(scored).select("ts", "symbol", "proposed")
    state = held.join(due.select("ts"), "ts", "left_semi").select("ts", "symbol", "current")
    rows = scored.select("ts", "symbol", "score").join(state, ["ts", "symbol"], "full").join(proposed, ["ts", "symbol"], "left")
    return strategy.rebalance_targets(rows, **limits).join(due, "ts")
