"""Reports before a run, trades and positions after it, and selections between."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.guards import stopped
from barspark.operators.sessions import assign, missing_and_unexpected, unfinished
from barspark.operators.spans import deviation, interval_moments, mean
from barspark.schema import by_time, ratio


def session_open_prices(bars: DataFrame, sessions: DataFrame, selected: str | None = None) -> DataFrame:
    """``bars`` in sessions with ``reference``: the open of the bar exactly at the session's opening, null without one.

    With ``selected``, a boolean column of stacked selected and support rows, a selected bar's open goes before that of a support bar, wherever both have one.
    """
    inside = assign(bars, sessions).where("label is not null")
    rank = F.coalesce(F.col(selected), F.lit(False)) if selected else F.lit(True)
    at_open = F.when((F.col("ts") == F.col("open_ts")) & F.col("open").isNotNull(), F.struct(rank.alias("first"), F.col("open").alias("open")))
    return inside.withColumn("reference", F.max(at_open).over(Window.partitionBy("symbol", "label"))["open"])


def omission_states(omissions: DataFrame, bars: DataFrame) -> DataFrame:
    """``omissions(symbol, ts, reason)`` with ``present``: whether the bars have them by now."""
    have = bars.select("symbol", "ts", F.lit(True).alias("present")).distinct()
    return omissions.join(have, ["symbol", "ts"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def omission_segments(bars: DataFrame, omissions: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """``bars`` with ``segment``, the number of omissions before them that are still missing: detectors that part by ``("symbol", "segment")`` never span one.

    ``unresolved(symbol, ...)`` are omissions in what processed bars were made of: such bars cannot be split, and a bar of their symbols stops the job.
    """
    if unresolved is not None:
        flagged = unresolved.select("symbol", F.lit(True).alias("_unresolved")).distinct()
        bars = stopped(bars.join(flagged, "symbol", "left"), F.col("_unresolved"), F.concat(F.lit("unresolved omissions in the source of "), F.col("symbol")), "ts").drop("_unresolved")
    marks = omissions.select("symbol", "ts").distinct().withColumn("_gap", F.lit(1))
    both = bars.withColumn("_gap", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("_lost", F.min("_gap").over(Window.partitionBy("symbol", "ts")))  # 0 where there is a bar
    order = Window.partitionBy("symbol").orderBy("ts", F.desc("_gap")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("segment", F.sum("_lost").over(order)).where("_gap = 0").drop("_gap", "_lost")


def omission_preview(omissions: DataFrame, most: int = 5) -> DataFrame:
    """By symbol how many omissions there are, and the first ones as text."""
    place = F.row_number().over(by_time())
    few = omissions.withColumn("_n", place)
    text = F.concat_ws(", ", F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.date_format("ts", "yyyy-MM-dd HH:mm")))))
    return few.groupBy("symbol").agg(F.count("*").alias("omitted"), text.alias("preview"))


def uncovered_sources(outputs: DataFrame, parents: DataFrame, step_seconds: int) -> DataFrame:
    """``outputs(symbol, ts, end_ts)``: the source times that each should have and the parents lack."""
    due = outputs.select("symbol", F.col("ts").alias("output_ts"), F.explode(F.sequence("ts", F.col("end_ts") - F.expr("INTERVAL 1 MICROSECOND"), F.expr(f"INTERVAL {step_seconds} SECONDS"))).alias("ts"))
    return due.join(parents.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def preflight(bars: DataFrame, symbols: DataFrame, grid: DataFrame, cutoff: str, bounds: tuple[str, str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """``(symbol, code, n)``: symbols without data, missing and unexpected bars, grid bars that are not over by the cutoff, and bars out of ``bounds``; codes in ``skip`` are not looked for."""
    parts = {
        "no_data": lambda: symbols.join(bars.select("symbol").distinct(), "symbol", "left_anti").select("symbol", F.lit("no_data").alias("code"), F.lit(1).cast("long").alias("n")),
        "missing": lambda: states.where("code = 'missing'"), "unexpected": lambda: states.where("code = 'unexpected'"),
        "unfinished": lambda: bars.join(unfinished(grid, cutoff).select("ts"), "ts").groupBy("symbol").agg(F.count("*").alias("n")).select("symbol", F.lit("unfinished").alias("code"), "n"),
    }
    states = missing_and_unexpected(bars, grid).groupBy("symbol", F.col("state").alias("code")).agg(F.count("*").alias("n"))
    if bounds:
        a, b = (F.lit(x).cast("timestamp") for x in bounds)
        parts["out_of_range"] = lambda: bars.where((F.col("ts") < a) | (F.col("ts") >= b)).groupBy("symbol").agg(F.count("*").alias("n")).select("symbol", F.lit("out_of_range").alias("code"), "n")
    return reduce(DataFrame.union, [f() for code, f in parts.items() if code not in skip])


def effective_starts(bars: DataFrame, lookback: int) -> DataFrame:
    """By symbol its first bar and the first with ``lookback`` bars before it."""
    n = F.row_number().over(by_time())
    return bars.withColumn("_n", n).groupBy("symbol").agg(F.min("ts").alias("listed"), F.min(F.when(F.col("_n") == lookback + 1, F.col("ts"))).alias("effective_start"))


def held_once(entries: DataFrame) -> DataFrame:
    """``entries(symbol, start_rn, end_rn)`` that act: a held symbol ignores what starts before its exit is over.

    Entries part into islands that overlap; one fold walks over one island.
    """
    order = Window.partitionBy("symbol").orderBy("start_rn", "end_rn")
    reach = F.max("end_rn").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("start_rn") > reach)).cast("int")
    islands = entries.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
    one = islands.groupBy("symbol", "_island").agg(F.sort_array(F.collect_list(F.struct(F.col("start_rn").cast("long").alias("s"), F.col("end_rn").cast("long").alias("e")))).alias("_all"))
    empty = F.struct(F.lit(-1).cast("long").alias("cursor"), F.array().cast("array<long>").alias("starts"))
    step = lambda a, x: F.when(x["s"] > a["cursor"], F.struct(x["e"].alias("cursor"), F.concat(a["starts"], F.array(x["s"])).alias("starts"))).otherwise(a)
    kept = one.select("symbol", F.explode(F.aggregate("_all", empty, step)["starts"]).alias("start_rn"))
    return entries.join(kept, ["symbol", "start_rn"], "left_semi")


def trade_results(trades: DataFrame, fee_bps: float) -> DataFrame:
    """``trades(entry, exit, quantity, direction)`` with gross, fees and net."""
    sign = F.when(F.col("direction") == "short", -1.0).otherwise(1.0)
    df = trades.withColumn("gross", sign * (F.col("exit") - F.col("entry")) * F.col("quantity"))
    df = df.withColumn("fees", (F.col("entry") + F.col("exit")) * F.col("quantity") * (fee_bps / 1e4))
    return df.withColumn("net", F.col("gross") - F.col("fees"))


def outcome_summary(trades: DataFrame, *keys: str) -> DataFrame:
    """Wins, losses and inconclusive trades, and the net of closed and of open ones, by direction."""
    is_ = lambda x: F.col("outcome") == x
    return trades.groupBy(*keys, "direction").agg(
        F.count_if(is_("win")).alias("wins"), F.count_if(is_("loss")).alias("losses"), F.count_if(is_("inconclusive")).alias("inconclusive"),
        F.sum(F.when(~is_("open"), F.col("net"))).alias("realised"), F.sum(F.when(is_("open"), F.col("net"))).alias("unrealised"),
    )


def marks(positions: DataFrame, prices: DataFrame, cash: float) -> DataFrame:
    """``positions(symbol, quantity)`` at each of ``prices(symbol, ts, close)``: value and weight of equity."""
    df = prices.join(positions, "symbol").withColumn("value", F.col("quantity") * F.col("close"))
    return df.withColumn("weight", ratio(F.col("value"), F.sum("value").over(Window.partitionBy("ts")) + cash))


def free_cash_budgets(candidates: DataFrame, cash: Column, slots: int | None = None, percent: float | None = None) -> DataFrame:
    """``budget`` of each candidate entry of a time: an even split of the free cash, a part a slot, or a fixed percentage."""
    n = F.count("*").over(Window.partitionBy("ts"))
    budget = cash * percent / 100 if percent is not None else cash / slots if slots else cash / n
    return candidates.withColumn("budget", F.floor(budget * 1e8) / 1e8)


def last_rows_of(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of each symbol."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return bars.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def screening(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """At most one row a ticker, in the order of ``requested(ticker, place)``, with all columns of ``rows``; a second row of a ticker stops the job."""
    values = [c for c in rows.columns if c != "ticker"]
    one = rows.groupBy("ticker").agg(*(F.any_value(c).alias(c) for c in values), F.count("*").alias("_rows"))
    one = stopped(one, F.col("_rows") > 1, F.concat(F.lit("more than one row of "), F.col("ticker").cast("string")), "ticker")
    return requested.join(one.drop("_rows"), "ticker").select("place", "ticker", *values)


def run_comparison(runs: DataFrame, identity: list[str]) -> DataFrame:
    """``runs`` with ``comparable``: whether all share one identity."""
    same = runs.agg((F.count_distinct(F.struct(*identity)) == 1).alias("comparable"))
    return runs.crossJoin(F.broadcast(same))  # one row


def filter_trends(trends: DataFrame, lambdas: list[float] | None, slopes: tuple[float, float] | None = None, without: bool = False) -> DataFrame:
    """``trends`` whose ``lambda_values`` meet the chosen ones (or are empty, with ``without``) and whose slope is in range."""
    if lambdas is not None:
        meets = F.arrays_overlap("lambda_values", F.array(*map(F.lit, lambdas)))
        trends = trends.where(F.coalesce(meets, F.lit(False)) | (F.lit(without) & (F.size("lambda_values") == 0)))
    return trends.where(F.col("slope").between(*slopes)) if slopes else trends


def entry_exit_signals(df: DataFrame, limit: float, exit_level: float) -> DataFrame:
    """``df(fast, slow, rsi)`` with entries (fast crosses above slow, RSI under the limit) and exits (crosses below, or RSI over the level)."""
    from barspark.functions.indicators import crossed_above, crossed_below
    from barspark.schema import true

    entry = crossed_above("fast", "slow") & true(F.col("rsi") < limit)
    return df.withColumns({"entry": entry, "exit": crossed_below("fast", "slow") | true(F.col("rsi") > exit_level)})


def last_month(periods: DataFrame, bars: DataFrame) -> DataFrame:
    """``periods(symbol, start_ts, end_ts)`` clipped to the last calendar month before the symbol's latest bar, inclusive."""
    latest = bars.groupBy("symbol").agg(F.max("ts").alias("_latest"))
    since = F.add_months("_latest", -1).cast("timestamp") + (F.unix_seconds("_latest") - F.unix_seconds(F.date_trunc("day", "_latest"))) * F.expr("INTERVAL 1 SECOND")
    df = periods.join(latest, "symbol").withColumn("_since", since).where(F.col("end_ts") >= F.col("_since"))
    return df.withColumn("start_ts", F.greatest("start_ts", "_since")).drop("_latest", "_since")


def period_means(periods: DataFrame, bars: DataFrame) -> DataFrame:
    """``periods(symbol, start_ts, end_ts)``, distinct, with the bars in each, the red ones among them, their mean close and the volatility of the returns in it; those without a bar are left out."""
    rows = bars.withColumn("_r", ratio(F.col("close"), F.lag("close").over(by_time())) - 1)
    found = interval_moments(rows, periods, "ts", {"bars": F.lit(True), "red": F.col("close") < F.col("open")}, {"closes": F.col("close")}, {"moves": F.col("_r")}).where("bars > 0")
    return found.select("symbol", "start_ts", "end_ts", "bars", "red", mean("closes").alias("mean"), (100 * deviation("moves")).alias("volatility"))


def joint_funding(orders: DataFrame, cash: float, by_priority: bool = False, reserve: float = 0.0) -> DataFrame:
    """``orders(ts, symbol, cost, score)`` with ``funded``: what cash less ``reserve`` pays, in proportion to cost where it is short, or in order of score until it is used up."""
    free = max(0.0, cash - reserve)
    if not by_priority:
        total = F.sum("cost").over(Window.partitionBy("ts"))
        return orders.withColumn("funded", F.col("cost") * F.least(F.lit(1.0), ratio(F.lit(free), total)))
    before = F.sum("cost").over(Window.partitionBy("ts").orderBy(F.desc("score"), "symbol").rowsBetween(Window.unboundedPreceding, -1))
    return orders.withColumn("funded", F.greatest(F.lit(0.0), F.least(F.col("cost"), free - F.coalesce(before, F.lit(0.0)))))


def suppress_redundant(intervals: DataFrame, least: int = 5, percent: float = 5.0, rule: str = "and") -> DataFrame:
    """``intervals(symbol, start_rn, end_rn, direction, clarity)`` without those that lie near a kept one of the same direction.

    Near are both ends (``and``) or either (``or``) within ``least`` bars or ``percent`` of the shorter of two.
    The earlier end goes first, at equal ends the clearer and then the longer; only kept intervals
    suppress. Under ``and``, intervals whose ends are further apart than any tolerance cannot meet,
    under ``or`` those that do not come within it of each other: the fold runs over clusters of the others.
    """
    if rule not in ("and", "or"):
        raise ValueError("rule must be 'and' or 'or'")
    group = Window.partitionBy("symbol", "direction")
    longest = F.max(F.col("end_rn") - F.col("start_rn") + 1).over(group)
    df = intervals.withColumn("_reach", F.greatest(F.lit(float(least)), longest * percent / 100))
    if rule == "and":
        order = group.orderBy("end_rn")
        new = F.col("end_rn") - F.lag("end_rn").over(order) > F.col("_reach")
    else:
        order = group.orderBy("start_rn", "end_rn")
        new = F.col("start_rn") - F.max("end_rn").over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("_reach")
    df = df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    df = df.withColumn("_cluster", F.sum("_new").over(order))
    item = F.struct(F.col("end_rn").cast("long").alias("e"), (-F.col("clarity")).alias("c"), F.col("start_rn").cast("long").alias("s"))
    one = df.groupBy("symbol", "direction", "_cluster").agg(F.sort_array(F.collect_list(item)).alias("_all"))
    kept_type = "array<struct<e: bigint, c: double, s: bigint>>"

    def step(kept: Column, x: Column) -> Column:
        def near(k: Column) -> Column:
            short = F.least(k["e"] - k["s"], x["e"] - x["s"]) + 1
            room = F.greatest(F.lit(100.0 * least), percent * short)
            starts, ends = 100 * F.abs(k["s"] - x["s"]) <= room, 100 * F.abs(k["e"] - x["e"]) <= room
            return (starts & ends) if rule == "and" else (starts | ends)

        return F.when(F.exists(kept, near), kept).otherwise(F.concat(kept, F.array(x)))

    kept = one.select("symbol", "direction", F.explode(F.aggregate("_all", F.array().cast(kept_type), step)).alias("k"))
    return kept.select("symbol", "direction", F.col("k.s").alias("start_rn"), F.col("k.e").alias("end_rn"), (-F.col("k.c")).alias("clarity"))
