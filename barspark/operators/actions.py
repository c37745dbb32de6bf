"""Corporate actions: factors of events, and the adjustment of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.schema import ratio, true

ZONE = "America/New_York"


def event_factors(events: DataFrame) -> DataFrame:
    """``events`` with ``price``, ``volume`` and ``fault`` (null where the terms are good).

    A split of ratio r gives 1/r and r. A cash dividend gives its factor, or (close - cash) / close,
    and leaves volumes; without a factor it must be in USD and stand alone on its day.
    """
    day = Window.partitionBy("symbol", F.to_date(F.from_utc_timestamp("effective_ts", ZONE)))
    cash = F.col("event_type") == "cash_dividend"
    split = F.col("event_type") == "split"
    derived = ratio(F.col("reference_close") - F.col("cash_amount"), F.col("reference_close"))
    price = F.when(split, ratio(F.lit(1.0), F.col("share_ratio"))).when(cash, F.coalesce("price_factor", derived))
    shared = F.count_if(cash | split).over(day) > 1
    fault = (
        F.when(~(cash | split), "unsupported")
        .when(split & ~true(F.col("share_ratio") > 0), "bad ratio")
        .when(cash & F.col("price_factor").isNull() & shared, "needs an explicit factor")
        .when(cash & F.col("price_factor").isNull() & ~true(F.col("currency") == "USD"), "currency")
        .when(cash & ~true((price > 0) & (price < 1)), "bad factor")
    )
    return events.withColumns({"price": price, "volume": F.when(split, F.col("share_ratio")).otherwise(1.0), "fault": fault})


def relevant(events: DataFrame, bars: DataFrame, reference_date: str) -> DataFrame:
    """Events that are not cancelled, after the symbol's first bar, and with an ex-date up to the reference date."""
    first = bars.groupBy("symbol").agg(F.min("ts").alias("_first"))
    local = F.to_date(F.from_utc_timestamp("effective_ts", ZONE))
    return events.join(first, "symbol").where((F.col("status") != "cancelled") & (F.col("effective_ts") > F.col("_first")) & (local <= F.lit(reference_date).cast("date"))).drop("_first")


def factor_schedule(events: DataFrame) -> DataFrame:
    """``(symbol, until, price, volume)``: the factors of bars before ``until`` and not before the boundary ahead of it, and ``log_price`` and ``log_volume``.

    Factors of one boundary multiply; later boundaries multiply into earlier bars. The logarithms are
    summed as decimals: they hold where some hundred factors leave the range of a double.
    """
    exact = lambda c: F.sum(F.log(c).cast("decimal(38,18)"))
    at = events.groupBy("symbol", F.col("effective_ts").alias("until")).agg(
        F.product("price").alias("price"), F.product("volume").alias("volume"), exact("price").alias("log_price"), exact("volume").alias("log_volume")
    )
    later = Window.partitionBy("symbol").orderBy(F.desc("until")).rowsBetween(Window.unboundedPreceding, 0)
    summed = [F.sum(c).over(later).cast("double").alias(c) for c in ("log_price", "log_volume")]
    return at.select("symbol", "until", F.product("price").over(later).alias("price"), F.product("volume").over(later).alias("volume"), *summed)


def adjust(bars: DataFrame, events: DataFrame, logs: bool = False) -> DataFrame:
    """Bars times the factors of all boundaries strictly after them; with ``logs``, the natural logarithms of these prices and volumes.

    Boundaries and bars are put in one order, latest first, and each bar takes the factor seen
    last: one shuffle by symbol, and no range join.
    """
    schedule = factor_schedule(events)
    names = bars.columns
    kind = "log_" if logs else ""
    marks = schedule.select("symbol", F.col("until").alias("ts"), F.lit(1).alias("_mark"), F.col(f"{kind}price").alias("_price"), F.col(f"{kind}volume").alias("_volume"))
    both = bars.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy(F.desc("ts"), "_mark").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(order), F.lit(0.0 if logs else 1.0))
    rows = both.withColumns({"_p": seen("_price"), "_v": seen("_volume")}).where("_mark = 0")
    by = dict.fromkeys(("open", "high", "low", "close"), "_p") | {"volume": "_v"}
    return rows.select(*[(F.log(c) + F.col(by[c]) if logs else F.col(c) * F.col(by[c])).alias(c) if c in by else F.col(c) for c in names])


def split_restored(dividends: DataFrame, splits: DataFrame) -> DataFrame:
    """``dividends(symbol, ts, amount)`` with ``original``: the amount times the ratios of all later splits."""
    marks = splits.select("symbol", "ts", F.col("ratio").alias("_ratio"), F.lit(1).alias("_mark"))
    both = dividends.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy(F.desc("ts"), "_mark").rowsBetween(Window.unboundedPreceding, 0)
    times = F.product(F.coalesce("_ratio", F.lit(1.0))).over(order)
    return both.withColumn("original", F.col("amount") * times).where("_mark = 0").drop("_mark", "_ratio")


def simple_split(ratio_: Column, tolerance: float = 1e-9) -> Column:
    """Whether a ratio is a whole number of at least two, or one over such."""
    whole = lambda x: (F.round(x) >= 2) & (F.abs(x - F.round(x)) <= tolerance)
    return true(whole(ratio_) | whole(ratio(F.lit(1.0), ratio_)))


def agreement(left: DataFrame, right: DataFrame, tolerance: float = 1e-6, relative: float = 0.0) -> DataFrame:
    """Two sources of ``(symbol, date, amount)`` by symbol and date, with ``state``; amounts agree within ``tolerance``, or within ``relative`` of the greater."""
    a, b = left.withColumnRenamed("amount", "a"), right.withColumnRenamed("amount", "b")
    room = F.greatest(F.lit(tolerance), relative * F.greatest(F.abs("a"), F.abs("b")))
    state = F.when(F.col("a").isNull(), "right only").when(F.col("b").isNull(), "left only").when(F.abs(F.col("a") - F.col("b")) <= room, "agree").otherwise("differ")
    return a.join(b, ["symbol", "date"], "full").withColumn("state", state)


def coverage_faults(coverage: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans(symbol, first_date, last_date)`` with ``fault`` where not exactly one complete unadjusted coverage row spans them."""
    good = (F.col("status") == "complete") & (F.col("source_basis") == "unadjusted") & (F.col("start_date") <= F.col("first_date")) & (F.col("end_date") >= F.col("last_date"))
    found = spans.join(coverage, "symbol", "left").groupBy("symbol", "first_date", "last_date").agg(F.count("status").alias("rows"), F.count_if(good).alias("good"))
    fault = F.when(F.col("rows") == 0, "no coverage").when(F.col("rows") > 1, "several coverage rows").when(F.col("good") == 0, "does not cover the bars")
    return found.withColumn("fault", fault)


def identity_faults(spans: DataFrame, coverage: DataFrame, events: DataFrame) -> DataFrame:
    """``spans(symbol, security_id, first_date, last_date)`` with ``faults``, sorted, that keep its bars from being adjusted; empty without one.

    ``other security``: a coverage row (symbol, start_date, end_date, security_id), or an event in the span, is of another security. ``unresolved event``: an event
    (symbol, security_id, effective_date, event_type, terms, status) in the span is unresolved. ``duplicate terms``: two of its events on a day are of one type and terms.
    Each table is joined on the symbol and cut to the span, so what is grouped is a symbol's rows in it.
    """
    each = ["symbol", "security_id", "first_date", "last_date"]
    own = spans.select(*each)
    other = coverage.select("symbol", F.col("security_id").alias("_id"), "start_date", "end_date")
    met = own.join(other, "symbol").where((F.col("end_date") >= F.col("first_date")) & (F.col("start_date") <= F.col("last_date")))
    inside = own.join(events.withColumnRenamed("security_id", "_id"), "symbol").where(F.col("effective_date").between(F.col("first_date"), F.col("last_date")))
    strange = ~F.col("_id").eqNullSafe(F.col("security_id"))
    repeated = inside.groupBy(*each, "effective_date", "event_type", "terms").agg(F.count("*").alias("_n")).where("_n > 1")
    found = (
        met.where(strange).select(*each, F.lit("other security").alias("fault"))
        .union(inside.where(strange).select(*each, F.lit("other security")))
        .union(inside.where(true(F.col("status") == "unresolved")).select(*each, F.lit("unresolved event")))
        .union(repeated.select(*each, F.lit("duplicate terms")))
    )
    every = own.select(*each, F.lit(None).cast("string").alias("fault"))
    return every.union(found).groupBy(*each).agg(F.array_sort(F.collect_set("fault")).alias("faults"))


def other_events(tickers: DataFrame, coverage: DataFrame, events: DataFrame) -> DataFrame:
    """Per requested ticker: each unsupported event, else ``none`` or ``coverage unknown``."""
    odd = events.where(~F.col("event_type").isin("split", "cash_dividend")).select("symbol", "event_type")
    known = coverage.where("other_events_status = 'complete'").select("symbol").distinct().withColumn("_known", F.lit(True))
    joined = tickers.join(odd, "symbol", "left").join(known, "symbol", "left")
    return joined.select("symbol", F.coalesce("event_type", F.when(F.col("_known"), F.lit("none")).otherwise(F.lit("coverage unknown"))).alias("report"))
