"""Factor panels, scores, target weights, portfolio rules and outcome labels, as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions import indicators as ind
from barspark.schema import by_time, either, finite, ratio, true


def factor_panel(bars: DataFrame, lookback: int, custom: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """``momentum``, ``volatility`` and ``red`` of each bar, and custom factors; what is not finite is null.

    A custom factor takes numbered bars and returns them, the same rows, with a column of its name.
    """
    df = ind.with_volatility(ind.numbered(bars), lookback)
    df = df.withColumns({"momentum": ind.momentum(lookback), "red": ind.red_bar_high(lookback)})
    for name, calculate in (custom or {}).items():
        if name in df.columns:
            raise ValueError(f"the factor {name} is there already")
        before, df = df.columns, calculate(df)
        if set(df.columns) != {*before, name}:
            raise ValueError(f"the factor {name} must add its column and no other")
    return df.withColumns({c: F.when(finite(c), F.col(c)) for c in ("momentum", "volatility", "red", *(custom or {}))})


def scored_panel(panel: DataFrame, factors: dict[str, tuple[int, float]]) -> DataFrame:
    """``panel`` with ``score``: for each factor (direction, weight) the average rank among the complete rows of a time, over their number; rounded to 12 places, so that equal ranks tie."""
    complete = ~either([F.col(c).isNull() for c in factors])
    df = panel.withColumn("_complete", complete)
    total = F.lit(0.0)
    for name, (direction, weight) in factors.items():
        ranked = F.rank().over(Window.partitionBy("ts", "_complete").orderBy(F.col(name) * direction))
        ties = F.count("*").over(Window.partitionBy("ts", "_complete", name))
        n = F.count("*").over(Window.partitionBy("ts", "_complete"))
        total = total + weight * (ranked + (ties - 1) / 2) / n
    return df.withColumn("score", F.when(F.col("_complete"), F.round(total, 12))).drop("_complete")


def source_index(bars: DataFrame, start: str) -> DataFrame:
    """``bars`` with ``source_index`` from 0 at the first bar not before ``start``, negative on the support before it."""
    support = (F.col("ts") < F.lit(start).cast("timestamp")).cast("long")
    before = F.sum(support).over(Window.partitionBy("symbol"))
    return bars.withColumn("source_index", F.row_number().over(by_time()) - 1 - before)


def target_weights(bars: DataFrame, fast: int, slow: int, lookback: int, weights: tuple[float, float]) -> DataFrame:
    """The 0/1 weights of an average crossing and of momentum, and their convex blend."""
    df = ind.numbered(bars)
    cross = F.when(true(ind.sma("close", fast) > ind.sma("close", slow)), 1.0).otherwise(0.0)
    rising = F.when(true(F.col("close") > F.lag("close", lookback).over(by_time())), 1.0).otherwise(0.0)
    df = df.withColumns({"cross_weight": cross, "momentum_weight": rising})
    return df.withColumn("blend", F.least(F.lit(1.0), weights[0] * F.col("cross_weight") + weights[1] * F.col("momentum_weight")))


def next_bar(df: DataFrame, weight: str) -> DataFrame:
    """``acting``, the weight decided on the bar before, and ``next_open``, where this bar's decision acts."""
    w = by_time()
    return df.withColumns({"acting": F.lag(weight).over(w), "next_open": F.lead("open").over(w)})


def equity_curve(df: DataFrame, weight: str, initial: float) -> DataFrame:
    """The frictionless ``equity`` of a symbol held by the weight of the bar before."""
    w = by_time()
    gain = F.coalesce(F.lag(weight).over(w), F.lit(0.0)) * F.coalesce(ratio(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))
    df = df.withColumn("_log", F.log1p(gain))
    return df.withColumn("equity", initial * F.exp(F.sum("_log").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_log")


def drifting_equity(prices: DataFrame, targets: DataFrame, initial: float = 1.0) -> DataFrame:
    """``(ts, equity)`` of a portfolio set to ``targets(ts, symbol, weight)`` at the closes of their times, whose weights drift until the next ones.

    ``prices(symbol, ts, close)``. What the weights leave is cash. A held symbol keeps its last price where
    it has no bar. Each time belongs to the last targets before it; growth within such a segment is the
    weighted sum of the symbols' growth since its start, and the segments' growth multiplies.
    """
    starts = targets.select("ts").distinct()
    following = F.lead("ts").over(Window.orderBy("ts"))  # a row a rebalance
    segments = starts.select(F.col("ts").alias("start"), following.alias("until"))
    marks = prices.select("ts").distinct().withColumn("_mark", F.lit(1))
    both = marks.unionByName(segments.select(F.col("start").alias("ts"), F.lit(0).alias("_mark")))
    at = both.groupBy("ts").agg(F.max("_mark").alias("_mark"), F.min("_mark").alias("_begins"))
    back = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)  # a row a bar time
    begun = F.last(F.when(F.col("_begins") == 0, F.col("ts")), ignorenulls=True).over(back)
    times = at.select("ts", begun.alias("start")).where("start is not null")
    held = targets.select(F.col("ts").alias("start"), "symbol", "weight")
    # what is held at a time, with the price then: the last one up to it
    due = times.join(held, "start").select("symbol", "ts", "start", "weight")
    entry = held.select("symbol", F.col("start").alias("ts"), "start", F.lit(None).cast("double").alias("weight"))
    asked = due.unionByName(entry).withColumn("close", F.lit(None).cast("double"))
    seen = prices.select("symbol", "ts", F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("double").alias("weight"), "close")
    up_to = Window.partitionBy("symbol").orderBy("ts", F.col("start").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    priced = seen.unionByName(asked).withColumn("_price", F.last("close", ignorenulls=True).over(up_to)).where("start is not null")
    base = priced.where("weight is null").select("symbol", "start", F.col("_price").alias("_base"))
    grown = priced.where("weight is not null").join(base, ["symbol", "start"])
    growth = 1 + F.sum(F.col("weight") * F.coalesce(ratio(F.col("_price"), F.col("_base")) - 1, F.lit(0.0)))
    curve = grown.groupBy("start", "ts").agg(growth.alias("_growth"))
    last = curve.groupBy("start").agg(F.max_by("_growth", "ts").alias("_whole"))
    earlier = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    scale = last.select("start", F.exp(F.coalesce(F.sum(F.log("_whole")).over(earlier), F.lit(0.0))).alias("_scale"))
    first = starts.agg(F.min("ts").alias("ts")).select("ts", F.lit(float(initial)).alias("equity"))
    return first.union(curve.join(scale, "start").select("ts", (initial * F.col("_scale") * F.col("_growth")).alias("equity")))


def performance(curve: DataFrame, *keys: str, trades: DataFrame | None = None) -> DataFrame:
    """``initial, final, total_return, max_drawdown`` of each curve of ``equity``, and of ``trades(*keys, fees)``, if given, ``trade_count`` and ``total_fees``."""
    keys = keys or ("symbol",)
    peak = F.max("equity").over(by_time(*keys).rowsBetween(Window.unboundedPreceding, 0))
    df = curve.withColumn("_drawdown", F.col("equity") / peak - 1)
    found = df.groupBy(*keys).agg(F.min_by("equity", "ts").alias("initial"), F.max_by("equity", "ts").alias("final"), F.min("_drawdown").alias("max_drawdown"))
    found = found.withColumn("total_return", ratio(F.col("final"), F.col("initial")) - 1)
    if trades is None:
        return found
    made = trades.groupBy(*keys).agg(F.count("*").alias("trade_count"), F.sum("fees").alias("total_fees"))
    return found.join(made, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("trade_count", "total_fees")})


def schedule(closes: DataFrame, every: int, tz: str = "UTC") -> DataFrame:
    """``closes(ts)`` with whether each is a rebalance of each kind; the last of a cut series ends no period."""
    w = Window.partitionBy(F.lit(0)).orderBy("ts")  # a calendar: a row a bar time
    local, following = F.from_utc_timestamp("ts", tz), F.from_utc_timestamp(F.lead("ts").over(w), tz)
    differs = lambda f: true(following.isNotNull() & (f(local) != f(following)))
    return closes.withColumns({
        "every_n": (F.row_number().over(w) - 1) % every == 0,
        "daily": differs(F.to_date),
        "weekly": differs(lambda x: F.struct(F.extract(F.lit("YEAROFWEEK"), x), F.weekofyear(x))),
        "monthly": differs(lambda x: F.date_format(x, "yyyy-MM")),
    })


def top_n(panel: DataFrame, n: int) -> DataFrame:
    """The ``n`` best scores of each time with ``place``, ties by symbol."""
    place = F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("score"), "symbol"))
    return panel.where("score is not null").withColumn("place", place).where(F.col("place") <= n)


def policy_weights(chosen: DataFrame) -> DataFrame:
    """Equal, score and inverse-volatility weights of the rows of each time."""
    w = Window.partitionBy("ts")
    inverse = F.when(F.col("volatility") > 0, 1 / F.col("volatility"))
    return chosen.withColumns({
        "equal_weight": 1.0 / F.count("*").over(w),
        "score_weight": ratio(F.col("score"), F.sum("score").over(w)),
        "inverse_volatility": ratio(inverse, F.sum(inverse).over(w)),
    })


def capped(df: DataFrame, weight: str, cap: float, budget: float, key: str = "ts") -> DataFrame:
    """``capped``: weights of at most ``cap`` that use the budget, the excess spread over the rest in proportion.

    Closed form: weights in falling order; the first one that stays under the cap after all
    before it are capped starts the free ones. Sums of tails are taken from the smallest up.
    """
    falling = Window.partitionBy(key).orderBy(F.desc(weight), "symbol")
    rising = Window.partitionBy(key).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    df = df.withColumn("_k", F.row_number().over(falling)).withColumn("_tail", F.sum(weight).over(rising))
    under = F.col(weight) * (budget - (F.col("_k") - 1) * cap) / F.col("_tail") < cap
    df = df.withColumn("_under", F.when(under, F.col("_k"))).withColumn("_first", F.min("_under").over(whole))
    free = F.col("_k") >= F.col("_first")
    df = df.withColumn("_free", F.sum(F.when(free, F.col(weight))).over(whole))
    share = F.col(weight) * (budget - (F.col("_first") - 1) * cap) / F.col("_free")
    return df.withColumn("capped", F.when(true(free), share).otherwise(F.lit(cap))).drop("_k", "_tail", "_under", "_first", "_free")


def with_frozen(df: DataFrame, reserve: float = 0.0, key: str = "ts") -> DataFrame:
    """``planned``: rows without a score keep ``current``; the others share what reserve and these leave, by ``target``."""
    w = Window.partitionBy(key)
    frozen = F.col("score").isNull()
    left = F.greatest(F.lit(0.0), 1 - reserve - F.coalesce(F.sum(F.when(frozen, F.col("current"))).over(w), F.lit(0.0)))
    share = ratio(F.col("target"), F.sum(F.when(~frozen, F.col("target"))).over(w))
    return df.withColumn("planned", F.when(frozen, F.col("current")).otherwise(F.coalesce(share, F.lit(0.0)) * left))


def rebalance_targets(df: DataFrame, reserve: float = 0.0, cap: float = 1.0, turnover: float = 2.0, least: float = 0.0, key: str = "ts") -> DataFrame:
    """The decision table of each time: ``df(symbol, score, current, proposed)`` with ``target``, ``frozen`` and ``reason``.

    ``proposed`` is a policy's weight (null: none), ``current`` the weight held (null: none). What is held
    without a score is frozen. The others share, by proposed weight and each at most ``cap``,
    the lesser of what was proposed and what reserve and frozen holdings leave. First come the
    mandatory reductions to cap and reserve; changes under ``least`` from there are dropped, increases
    are cut to what is free, and what remains of the ``turnover`` budget scales the rest.
    """
    whole = Window.partitionBy(key)
    total = lambda x: F.coalesce(F.sum(x).over(whole), F.lit(0.0))
    zero, tiny = F.lit(0.0), 1e-12
    df = df.withColumns({"current": F.coalesce("current", zero), "_score": F.col("score").isNotNull()})
    df = df.withColumn("frozen", ~F.col("_score") & (F.col("current") > 0))
    df = df.withColumn("_relative", F.when(F.col("_score"), F.greatest(F.coalesce("proposed", zero), zero)).otherwise(zero))
    df = df.withColumns({"_frozen": total(F.when(F.col("frozen"), F.col("current"))), "_asked": total(F.col("_relative"))})
    df = df.withColumn("_room", F.greatest(zero, 1 - reserve - F.col("_frozen"))).withColumn("_usable", F.least("_room", "_asked"))
    df = df.withColumn("_scaled", F.coalesce(ratio(F.col("_relative"), F.col("_asked")), zero) * F.col("_usable"))
    # the capped shares: in falling order the first that stays under the cap after all before it are capped
    falling = Window.partitionBy(key).orderBy(F.desc("_relative"), "symbol")
    df = df.withColumn("_k", F.row_number().over(falling))
    df = df.withColumn("_tail", F.sum("_relative").over(Window.partitionBy(key).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)))
    under = F.col("_relative") * (F.col("_usable") - (F.col("_k") - 1) * cap) <= cap * F.col("_tail")
    df = df.withColumn("_first", F.min(F.when(under, F.col("_k"))).over(whole))
    free = true(F.col("_k") >= F.col("_first"))
    df = df.withColumn("_free", total(F.when(free, F.col("_relative"))))
    share = F.coalesce(ratio(F.col("_relative"), F.col("_free")), zero) * (F.col("_usable") - (F.col("_first") - 1) * cap)
    wish = F.when(F.col("frozen"), F.col("current")).when(free, share).otherwise(F.lit(cap))
    df = df.withColumn("_wish", wish)
    # what must be sold before any wish counts
    base = F.when(F.col("frozen"), F.col("current")).otherwise(F.least(F.col("current"), F.lit(cap)))
    df = df.withColumn("_base", base).withColumn("_held", total(F.when(~F.col("frozen"), F.col("_base"))))
    down = F.when(~F.col("frozen") & (F.col("_held") > F.col("_room")), ratio(F.col("_room"), F.col("_held"))).otherwise(F.lit(1.0))
    df = df.withColumn("_base", F.col("_base") * down).withColumn("_must", total(F.abs(F.col("_base") - F.col("current"))))
    small = ~F.col("frozen") & (F.col("_wish") > 0) & (F.abs(F.col("_wish") - F.col("_base")) < least)
    df = df.withColumn("_small", small).withColumn("_wish1", F.when(F.col("_small"), F.col("_base")).otherwise(F.col("_wish")))
    df = df.withColumns({"_sold": total(F.greatest(zero, F.col("_base") - F.col("_wish1"))), "_bought": total(F.greatest(zero, F.col("_wish1") - F.col("_base"))), "_base_total": total(F.col("_base"))})
    df = df.withColumn("_available", F.greatest(zero, 1 - reserve - F.col("_base_total")) + F.col("_sold"))
    df = df.withColumn("_short", (F.col("_bought") > F.col("_available") + tiny) & (F.col("_wish1") > F.col("_base")))
    df = df.withColumn("_wish2", F.when(F.col("_short"), F.col("_base") + (F.col("_wish1") - F.col("_base")) * F.col("_available") / F.col("_bought")).otherwise(F.col("_wish1")))
    df = df.withColumns({"_free_moves": total(F.abs(F.col("_wish2") - F.col("_base"))), "_left": F.greatest(zero, turnover - F.col("_must"))})
    tight = (F.col("_free_moves") > F.col("_left") + tiny) & (F.abs(F.col("_wish2") - F.col("_base")) > tiny)
    df = df.withColumn("target", F.when(tight, F.col("_base") + F.col("_left") / F.col("_free_moves") * (F.col("_wish2") - F.col("_base"))).otherwise(F.col("_wish2")))
    cut = ~F.col("frozen") & (F.col("_scaled") + tiny < F.coalesce("proposed", zero))
    moved = F.abs(F.col("_base") - F.col("current")) > tiny
    reasons = [
        (F.col("frozen"), "frozen: no score"), (~F.col("frozen") & (F.col("_relative") > 0), "selected"), (~F.col("frozen") & (F.col("_relative") == 0), "not selected"),
        (cut, "reduced for reserve and frozen holdings"), (~F.col("frozen") & (F.col("_wish") + tiny < F.col("_scaled")), "reduced by cap"),
        (F.col("frozen") & (F.col("_frozen") > 1 - reserve + tiny), "frozen holdings exceed the reserve"), (moved, "mandatory reduction"),
        (moved & (F.col("_must") > turnover + tiny), "mandatory changes exceed the turnover budget"), (F.col("_small"), "change below the least"),
        (F.col("_short"), "reduced to keep the reserve"), (tight, "limited by the turnover budget"),
    ]
    df = df.withColumn("reason", F.concat_ws("; ", *[F.when(true(c), F.lit(x)) for c, x in reasons]))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def limit_turnover(df: DataFrame, budget: float, least: float = 0.0, key: str = "ts") -> DataFrame:
    """``executed``: changes from ``current`` to ``target`` of at least ``least``, scaled to the turnover budget of a time, with ``reason``.

    It knows no cap, reserve or frozen holdings; :func:`rebalance_targets` does.
    """
    raw = F.col("target") - F.col("current")
    df = df.withColumn("_change", F.when(F.abs(raw) < least, 0.0).otherwise(raw))
    df = df.withColumn("_turnover", F.sum(F.abs("_change")).over(Window.partitionBy(key)))
    scale = F.when(F.col("_turnover") > budget, budget / F.col("_turnover")).otherwise(1.0)
    reason = F.concat_ws("; ", F.when((F.col("_change") == 0) & (raw != 0), F.lit("below the least change")), F.when(F.col("_turnover") > budget, F.lit("scaled to the turnover budget")))
    return df.withColumns({"executed": F.col("current") + F.col("_change") * scale, "reason": reason}).drop("_change", "_turnover")


def first_beyond(bars: DataFrame, entries: DataFrame, width: int = 64) -> DataFrame:
    """``entries(symbol, rn, upper, lower)`` with ``hit``: the first later row of ``bars(symbol, rn, high, low)`` above ``upper`` or below ``lower``, null without one.

    Bars form a tree: a node is ``width`` nodes of the level below with their highest high and
    lowest low. An entry climbs from its bar until the rest of a node has a hit, then goes down
    to it. Each step is a join on symbol and node that reads at most ``width`` children, so the
    work grows with the number of entries and the logarithm of the history, however far the hit is.
    """
    last = bars.agg(F.max("rn")).first()[0] or 0
    level, levels, reach = bars.select("symbol", F.col("rn").cast("long").alias("_at"), "high", "low"), [], 1
    while True:
        child = F.struct("_at", "high", "low")
        level = level.groupBy("symbol", F.floor(F.col("_at") / width).alias("_node")).agg(
            F.sort_array(F.collect_list(child)).alias("_children"), F.max("high").alias("_top"), F.min("low").alias("_bottom")
        )
        levels.append(level.select("symbol", "_node", "_children"))
        reach *= width
        if reach > last:
            break
        level = level.select("symbol", F.col("_node").alias("_at"), F.col("_top").alias("high"), F.col("_bottom").alias("low"))
    beyond = lambda x: (x["high"] > F.col("upper")) | (x["low"] < F.col("lower"))
    df = entries.withColumns({"_up": F.col("rn").cast("long"), "hit": F.lit(None).cast("long"), "_found": F.lit(None).cast("int")})
    for k, nodes in enumerate(levels):
        df = df.withColumn("_node", F.floor(F.col("_up") / width)).join(nodes, ["symbol", "_node"], "left")
        first = F.get(F.filter("_children", lambda x: (x["_at"] > F.col("_up")) & beyond(x)), F.lit(0))["_at"]
        open_ = F.col("_found").isNull()
        df = df.withColumn("_first", first).withColumns({"hit": F.when(open_, F.col("_first")).otherwise(F.col("hit")), "_found": F.when(open_ & F.col("_first").isNotNull(), F.lit(k)).otherwise(F.col("_found")), "_up": F.col("_node")})
        df = df.drop("_node", "_children", "_first")
    for k in range(len(levels) - 2, -1, -1):
        down = F.col("_found") > k
        df = df.withColumn("_node", F.when(down, F.col("hit"))).join(levels[k], ["symbol", "_node"], "left")
        first = F.get(F.filter("_children", beyond), F.lit(0))["_at"]
        df = df.withColumn("hit", F.when(down, first).otherwise(F.col("hit"))).drop("_node", "_children")
    return df.drop("_up", "_found")


def bracket_outcomes(bars: DataFrame, entry: Column, win: float, stop: float, direction: Column | None = None) -> DataFrame:
    """Each entry signal at the next open, labelled by the first later bar strictly beyond a bound, however late.

    The bounds of a long entry are the open times ``win`` and ``stop``, those of a ``short`` one
    the open over them. Both bounds in one bar give ``inconclusive``, none by the end of the
    bars ``open``. Bars are numbered (``rn``).
    """
    side = F.lit("long") if direction is None else direction
    short = F.col("direction") == "short"
    price = F.col("entry")
    df = bars.withColumns({"entry": F.lead("open").over(by_time()), "direction": side}).where(entry).where("entry is not null")
    df = df.withColumns({"upper": F.when(short, price / stop).otherwise(price * win), "lower": F.when(short, price / win).otherwise(price * stop)})
    found = first_beyond(bars, df.select("symbol", "rn", "upper", "lower"))
    at_hit = bars.select("symbol", F.col("rn").cast("long").alias("hit"), F.col("high").alias("_high"), F.col("low").alias("_low"))
    df = df.join(found.select("symbol", "rn", "hit"), ["symbol", "rn"]).join(at_hit, ["symbol", "hit"], "left")
    up, down = F.col("_high") > F.col("upper"), F.col("_low") < F.col("lower")
    outcome = F.when(F.col("hit").isNull(), "open").when(up & down, "inconclusive").when(up != short, "win").otherwise("loss")
    return df.withColumn("outcome", outcome).drop("_high", "_low")


def open_bands(bars: DataFrame, percent: float, group: Column | None = None, mode: str = "group") -> DataFrame:
    """``reference`` and levels ``percent`` above and below it: the open of each ``bar``, of the ``first`` bar of the symbol, or of the first of its ``group``."""
    if mode not in ("bar", "first", "group") or (mode == "group") != (group is not None):
        raise ValueError("the mode is bar, first or group, and a group goes with the last")
    keys = ["symbol"] if group is None else ["symbol", group]
    first = F.col("open") if mode == "bar" else F.first("open").over(Window.partitionBy(*keys).orderBy("ts"))
    return bars.withColumn("reference", first).withColumns({"upper": F.col("reference") * (1 + percent / 100), "lower": F.col("reference") * (1 - percent / 100)})


def eligible(df: DataFrame, lookback: int, starts: DataFrame | None = None) -> DataFrame:
    """Rows with at least ``lookback`` observations of their symbol, and not before the start that ``starts(symbol, effective_start)`` has for it, if any."""
    df = df.withColumn("_n", F.row_number().over(by_time())).where(F.col("_n") >= lookback).drop("_n")
    if starts is None:
        return df
    known = starts.select("symbol", F.col("effective_start").alias("_from"))
    return df.join(known, "symbol", "left").where("_from is null or ts >= _from").drop("_from")


def order_sizes(df: DataFrame, fixed_fee: float, fee_bps: float, slip_bps: float) -> DataFrame:
    """Whole shares to reach ``weight`` of ``equity`` at ``open``: price with slippage, fee rounded up to 8 places, and what ``cash`` affords."""
    wanted = F.floor(F.col("weight") * F.col("equity") / F.col("open")) - F.col("held")
    price = F.col("open") * (1 + F.signum(wanted) * slip_bps / 1e4)
    fee = lambda q: F.ceil((fixed_fee + F.abs(q) * price * fee_bps / 1e4) * 1e8) / 1e8
    bound = F.floor((F.col("cash") - fixed_fee) / (price * (1 + fee_bps / 1e4)))
    # the fee's rounding can take the bound over what cash affords: the largest of a few below it that passes
    tries = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.greatest(bound - i, F.lit(0)))
    affordable = F.array_max(F.filter(tries, lambda q: q * price + fee(q) <= F.col("cash")))
    filled = F.when(F.col("volume") == 0, F.lit(0)).when(wanted > 0, F.least(wanted, F.coalesce(affordable, F.lit(0)))).otherwise(wanted).cast("long")
    status = F.when((F.col("volume") == 0) & (wanted != 0), "rejected").when(filled == wanted, "filled").when(filled == 0, "rejected").otherwise("reduced")
    return df.withColumns({"wanted": wanted.cast("long"), "filled": filled, "price": price, "fee": F.when(filled == 0, 0.0).otherwise(fee(filled)), "status": status})
