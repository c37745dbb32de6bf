"""Vendor revisions of corporate actions to one resolved event each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.schema import ratio, true

# Fixed values of the vendor: event codes, revision states that withdraw an event, and factor states.
EVENT_TYPES = {
    "FSPLT": "forward_split", "SD": "forward_split", "RSPLT": "reverse_split", "CONSD": "reverse_split", "DMRGR": "spin_off", "RTS": "rights_issue", "MRGR": "merger",
    "TKOVR": "acquisition", "CONV": "share_exchange", "DRCHG": "adr_ratio_change", "CURRD": "currency_redenomination", "LCC": "symbol_change", "DELIST": "delisting", "RCAP": "return_of_capital",
}
WITHDRAWN, LIVE = ("C", "D", "P", "Q"), ("I", "U")
SPLITS, DIVIDENDS = ("forward_split", "reverse_split", "stock_dividend"), ("cash_dividend", "special_cash_dividend")
DIVIDEND_REASON = 17


def event_type() -> Column:
    """The kind of event of a record by its code, subtype, payment and marker."""
    code, subtype = F.col("event"), F.coalesce("event_subtype", F.lit(""))
    own = true(F.col("outturn_security_id") == F.col("security_id"))
    mapped = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
    dividend = (
        F.when(subtype == "CAPDIST", "return_of_capital")
        .when(true(F.col("payment_type") == "C") & F.col("event_subtype").isNull(), F.when(true(F.col("marker") == "SPL"), "special_cash_dividend").otherwise("cash_dividend"))
        .when(true(F.col("payment_type") == "S") & (subtype == "DIV") & own, "stock_dividend").otherwise("unsupported_dividend")
    )
    return (
        F.when((code == "FSPLT") & subtype.isin("DIV", "BON"), F.when(own, "stock_dividend").otherwise("unsupported_stock_distribution"))
        .when(F.try_element_at(mapped, code).isNotNull(), F.try_element_at(mapped, code)).when(code == "DIV", dividend).otherwise(F.lower(F.coalesce(code, F.lit("unknown"))))
    )


def latest_records(records: DataFrame, fetched_at: str) -> DataFrame:
    """Of each ``event_unique_id`` the newest record up to ``fetched_at``, with ``revisions`` and ``conflict``: whether records of that newest time differ."""
    known = records.where(F.col("ts_record") <= F.lit(fetched_at).cast("timestamp"))
    content = F.xxhash64(*[c for c in records.columns if c != "ts_record"])
    whole, newest = Window.partitionBy("event_unique_id"), Window.partitionBy("event_unique_id", "ts_record")
    df = known.withColumn("_content", content).withColumns({
        "revisions": F.count("*").over(whole), "conflict": F.min("_content").over(newest) != F.max("_content").over(newest),
        "_n": F.row_number().over(whole.orderBy(F.desc("ts_record"), "_content")),
    })
    return df.where("_n = 1").drop("_n", "_content")


def dividend_factors(factors: DataFrame, fetched_at: str, exchange: str) -> DataFrame:
    """``(event_id, security_id, ex_date, factor, factor_status, factor_fault)``: what is in force of each dividend's factors by ``fetched_at``.

    The newest state of each value counts; a rescinded value (R) is gone, and more than one left is a
    fault, as are mixed options, reasons or currencies. With all rescinded the newest one stands, pending.
    """
    keys = ["event_id", "security_id", "ex_date"]
    known = factors.where((F.col("exchange") == exchange) & (F.col("ts_created") <= F.lit(fetched_at).cast("timestamp")))
    state = F.struct("ts_created", "status")
    by_value = known.groupBy(*keys, "factor").agg(
        F.max(state).alias("now"), F.count_if((F.col("reason") != DIVIDEND_REASON) | (F.col("dividend_currency") != "USD")).alias("odd"), F.count_if(~F.col("status").isin("A", "P", "R")).alias("unknown"),
        F.min("option").alias("least"), F.max("option").alias("most"),
    )
    live = F.col("now.status") != "R"
    found = by_value.groupBy(*keys).agg(
        F.sum("odd").alias("odd"), F.sum("unknown").alias("unknown"), (F.min("least") != F.max("most")).alias("options"), F.count_if(live).alias("live"),
        F.coalesce(F.max_by(F.struct("factor", "now.status"), F.when(live, F.col("now"))), F.max_by(F.struct("factor", "now.status"), "now")).alias("f"),
    )
    fault = (
        F.when(F.col("odd") > 0, "unsupported reason or currency").when(true(F.col("options")), "several options").when(F.col("unknown") > 0, "unknown status").when(F.col("live") > 1, "several values in force")
    )
    return found.select(*keys, F.col("f.factor").alias("factor"), F.col("f.status").alias("factor_status"), fault.alias("factor_fault"))


def resolved_events(records: DataFrame, factors: DataFrame, start: str, reference_date: str, fetched_at: str, exchange: str) -> DataFrame:
    """One row an event whose date is in ``[start, reference_date]``: type, date, ``status``, ``share_ratio``, ``cash_amount``, ``price_factor`` and ``fault``.

    Of an event's newest records the one that is not withdrawn counts; several are a fault. Withdrawn events
    are ``cancelled``; a split needs both sides of its ratio, a cash dividend US dollars, a positive amount and
    one factor in force between 0 and 1. What lacks any of it is ``pending`` with the ``fault`` and no numbers.
    """
    df = latest_records(records, fetched_at).withColumn("_live", ~F.col("event_action").isin(*WITHDRAWN))
    event = Window.partitionBy("security_id", "event_id")
    df = df.withColumns({"_options": F.count_if("_live").over(event), "_n": F.row_number().over(event.orderBy(F.desc("_live"), "event_unique_id"))}).where("_n = 1")
    df = df.withColumn("event_type", event_type())
    supported = F.col("event_type").isin(*SPLITS, *DIVIDENDS)
    effective = F.when(supported, F.col("ex_date")).otherwise(F.coalesce("effective_date", "event_date", "ex_date"))
    df = df.withColumn("effective", effective).where(F.col("effective").isNull() | F.col("effective").between(F.lit(start).cast("date"), F.lit(reference_date).cast("date")))
    df = df.join(dividend_factors(factors, fetched_at, exchange), ["event_id", "security_id", "ex_date"], "left")
    split, paid = F.col("event_type").isin(*SPLITS), F.col("event_type").isin(*DIVIDENDS)
    cancelled = F.col("event_action").isin(*WITHDRAWN)
    shares = F.when(split & true(F.col("ratio_old") > 0) & true(F.col("ratio_new") > 0), ratio(F.col("ratio_new"), F.col("ratio_old")))
    fault = (
        F.when(F.col("conflict"), "conflicting revisions").when(F.col("_options") > 1, "several benefits").when(F.col("effective").isNull(), "no date").when(~F.col("event_action").isin(*LIVE, *WITHDRAWN), "unknown state")
        .when(cancelled | ~supported, None).when(~true(F.col("trading_currency") == "USD"), "trading currency").when(split & shares.isNull(), "no share ratio")
        .when(paid & ~true(F.col("rate_currency") == "USD"), "dividend currency").when(paid & F.col("factor_status").isNull(), "no factor").when(paid & F.col("factor_fault").isNotNull(), F.col("factor_fault"))
        .when(paid & (F.col("factor_status") == "A") & ~true((F.col("factor") > 0) & (F.col("factor") < 1)), "factor out of range").when(paid & true(F.col("gross_dividend") <= 0), "amount not positive")
    )
    df = df.withColumn("fault", fault)
    good = F.col("fault").isNull() & ~cancelled & supported
    status = F.when(F.col("fault").isNotNull(), "pending").when(cancelled, "cancelled").when(paid & (F.col("factor_status") != "A"), "pending").otherwise("apply")
    price = F.when(split, 1 / shares).when(F.col("factor_status") == "A", F.col("factor"))
    return df.select(
        "event_id", "security_id", "symbol", "event_type", F.col("effective").alias("effective_date"), status.alias("status"), F.when(good, shares).alias("share_ratio"),
        F.when(good & paid, F.col("gross_dividend")).alias("cash_amount"), F.when(good, price).alias("price_factor"), "revisions", "fault",
    )
