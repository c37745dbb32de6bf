"""Order sizes, fees and split capital in decimals: exact to the last place, as far as it is stated.

Prices and quantities have 8 places and are below a million, money has 8 places and is below 10^14; what does not fit
raises an error. Slippage is applied and rounded half up to 8 places, fees are rounded up to 8 places, quantities
are rounded down to a step. Products keep all their places, and quotients are only first guesses that products check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE, QUANTITY, MONEY, SHARE = "decimal(14, 8)", "decimal(14, 8)", "decimal(22, 8)", "decimal(8, 8)"


def _exact(x, kind: str) -> Column:
    return (F.lit(str(x)) if isinstance(x, (int, float)) else F.col(x) if isinstance(x, str) else x).cast(kind)


def _stepped(x: Column, step: str) -> Column:
    """``x`` rounded down to whole numbers or 8 places."""
    return F.floor(x).cast(QUANTITY) if step == "whole" else F.floor(x, F.lit(8)).cast(QUANTITY)


def fee(notional: Column, fixed: Column, share: Column) -> Column:
    """``fixed`` and a share of the notional, rounded up to 8 places."""
    return F.ceil(fixed + notional * share, F.lit(8)).cast(MONEY)


def order_sizes(df: DataFrame, fixed_fee: float, fee_bps: float, slip_bps: float, step: str = "whole", least_budget: float = 0.0) -> DataFrame:
    """Quantities to reach ``weight`` of ``cash + held * open`` at ``open``: ``wanted``, ``filled``, ``price``, ``fee``, ``cash_after``, ``held_after``, ``status`` and ``reason``, in decimals.

    ``step`` is ``whole`` or ``fraction`` (8 places). A buy takes the largest quantity that ``cash``, or for fractions the
    lesser of cash and what the order is to be worth, pays with its fee; a budget under ``least_budget`` is rejected. A sale is rejected
    where proceeds and cash do not cover the fee.
    """
    if step not in ("whole", "fraction"):
        raise ValueError("step is whole or fraction")
    one = F.lit("1" if step == "whole" else "0.00000001").cast(QUANTITY)
    fixed, share, slip = _exact(fixed_fee, MONEY), _exact(fee_bps / 1e4, SHARE), _exact(slip_bps / 1e4, SHARE)
    df = df.withColumns({"_open": _exact("open", PRICE), "_held": _exact("held", QUANTITY), "_cash": _exact("cash", MONEY), "_weight": _exact("weight", "decimal(9, 8)")})
    df = df.withColumn("_equity", (F.col("_cash") + F.col("_held") * F.col("_open")).cast("decimal(27, 16)"))
    df = df.withColumn("_target", (F.col("_weight").cast("decimal(9, 8)") * F.col("_equity").cast("decimal(22, 8)")).cast("decimal(30, 16)"))
    # the quotient is rounded, so the next step up and down decide by their products
    guess = _stepped(F.col("_target").cast("decimal(30, 16)") / F.col("_open"), step)
    tries = F.array(*[guess + one * k for k in (1, 0, -1)])
    fits = F.filter(tries, lambda q: (q >= 0) & ((q * F.col("_open")).cast("decimal(30, 16)") <= F.col("_target")))
    df = df.withColumn("_desired", F.coalesce(F.get(fits, F.lit(0)), F.lit(0)).cast(QUANTITY))
    df = df.withColumn("wanted", (F.col("_desired") - F.col("_held")).cast(QUANTITY))
    buys = F.col("wanted") > 0
    df = df.withColumn("price", F.round(F.col("_open") * F.when(buys, 1 + slip).otherwise(1 - slip), 8).cast(PRICE))
    worth = (F.col("_target") - (F.col("_held") * F.col("_open")).cast("decimal(30, 16)")).cast("decimal(30, 16)")
    budget = F.col("_cash").cast("decimal(30, 16)")
    df = df.withColumn("_budget", budget if step == "whole" else F.least(budget, worth))
    cost = lambda q: ((q * F.col("price")).cast("decimal(30, 16)") + fee(q * F.col("price"), fixed, share).cast("decimal(30, 16)"))
    about = F.greatest(F.lit(0).cast(QUANTITY), _stepped(F.greatest(F.lit(0).cast("decimal(30, 16)"), F.col("_budget") - fixed) / (F.col("price") * (1 + share)).cast("decimal(24, 16)"), step))
    df = df.withColumn("_about", about)
    # rounding up the fee adds less than one unit of the last place: what is paid lies by the guess, or by what its fee or one unit less leaves
    unit, due = F.lit("0.00000001").cast("decimal(30, 16)"), fee(F.col("_about") * F.col("price"), fixed, share).cast("decimal(30, 16)")
    left = lambda f: _stepped((F.greatest(F.lit(0).cast("decimal(30, 16)"), F.col("_budget") - f).cast("decimal(30, 16)")) / F.col("price"), step)
    df = df.withColumn("_few", F.array(F.col("_about"), left(due), left((due - unit).cast("decimal(30, 16)"))))
    few = F.flatten(F.transform("_few", lambda q: F.array(*[F.least(F.col("wanted"), q + one * k).cast(QUANTITY) for k in (1, 0, -1)])))
    affords = F.array_max(F.filter(few, lambda q: (q >= 0) & (cost(q) <= F.col("_budget"))))
    df = df.withColumn("_buy", F.when(F.col("_budget") < F.lit(str(least_budget)).cast(MONEY), F.lit(0)).otherwise(F.coalesce(affords, F.lit(0))).cast(QUANTITY))
    sold = F.least(-F.col("wanted"), F.col("_held")).cast(QUANTITY)
    df = df.withColumn("_sold", F.when(~buys, sold).otherwise(F.lit(0)).cast(QUANTITY))
    proceeds = (F.col("_cash") + (F.col("_sold") * F.col("price")).cast("decimal(30, 16)") - fee(F.col("_sold") * F.col("price"), fixed, share)).cast("decimal(30, 16)")
    df = df.withColumn("_short", ~buys & (F.col("wanted") < 0) & (proceeds < 0))
    df = df.withColumn("filled", F.when(buys, F.col("_buy")).when(F.col("_short"), F.lit(0)).otherwise(-F.col("_sold")).cast(QUANTITY))
    size = F.abs("filled")
    df = df.withColumn("fee", F.when(F.col("filled") == 0, F.lit(0)).otherwise(fee(size * F.col("price"), fixed, share)).cast(MONEY))
    after = F.col("_cash").cast("decimal(30, 16)") - (F.col("filled") * F.col("price")).cast("decimal(30, 16)") - F.col("fee").cast("decimal(30, 16)")
    status = F.when(F.col("wanted") == 0, "none").when(F.col("filled") == 0, "rejected").when(F.col("filled") == F.col("wanted"), "filled").otherwise("reduced")
    df = df.withColumns({"cash_after": after.cast("decimal(30, 16)"), "held_after": (F.col("_held") + F.col("filled")).cast(QUANTITY), "status": status})
    small = F.lit(step == "fraction") & buys & (F.col("_budget") < F.lit(str(least_budget)).cast(MONEY))
    reason = F.when(F.col("_short"), "sale proceeds do not cover the fee").when(small, "below the least budget").when(buys & (F.col("filled") == 0), "not enough cash").when(F.col("status") == "reduced", "limited by cash")
    df = df.withColumn("reason", F.coalesce(reason, F.lit("")))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def split_capital(accounts: DataFrame, initial: float, strategy: str = "strategy") -> DataFrame:
    """``accounts(strategy, ticker, growth)`` to totals by strategy in decimals: equal parts rounded down to 8 places, what is left stays idle."""
    whole = _exact(initial, MONEY)
    n = F.count("*").over(Window.partitionBy(strategy)).cast("decimal(10, 0)")
    guess = F.floor(whole / n, F.lit(8)).cast(MONEY)
    part = F.when(guess * n > whole, guess - F.lit("0.00000001").cast(MONEY)).otherwise(guess).cast(MONEY)
    df = accounts.withColumn("_part", part).withColumn("_grown", (F.col("_part") * _exact("growth", "decimal(14, 8)")).cast("decimal(28, 16)"))
    found = df.groupBy(strategy).agg(F.sum("_grown").alias("invested"), (whole - F.sum("_part")).alias("idle"), F.count("*").alias("accounts"))
    return found.withColumn("total", F.col("invested") + F.col("idle"))
