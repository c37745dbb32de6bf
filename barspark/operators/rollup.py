"""Roll-ups of per-ticker metrics, null-safe: missing is never zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.schema import finite, ratio, true


def reduce_metric(rows: DataFrame, key: str, value: str, how: str, order: str, category: tuple[str, str] | None = None) -> DataFrame:
    """One ``metric`` a key: ``single`` (null unless there is one row), first, last, sum, mean, min, max or count."""
    if category:
        rows = rows.where(F.col(category[0]) == category[1])
    v = F.col(value)
    how_ = {
        "single": F.when(F.count("*") == 1, F.max(v)), "first": F.min_by(v, order), "last": F.max_by(v, order), "sum": F.sum(v),
        "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "count": F.count(v),
    }[how]
    return rows.groupBy(key).agg(how_.cast("double").alias("metric"))


def across_tickers(metrics: DataFrame, *values: str) -> DataFrame:
    """Sum, mean, least and greatest over tickers and how many contribute, a row a metric."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])).alias("m")
    return metrics.select(named).select("m.*").groupBy("metric").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.count("value").alias("contributors"))


def ratio_of_sums(metrics: DataFrame, numerator: str, denominator: str, scale: float = 1.0) -> DataFrame:
    """Over the tickers that have both; null for a zero denominator."""
    both = F.col(numerator).isNotNull() & F.col(denominator).isNotNull()
    part = lambda c: F.sum(F.when(both, F.col(c)))
    return metrics.agg((ratio(part(numerator), part(denominator)) * scale).alias("ratio"), F.count_if(both).alias("contributors"))


def exact_sum(c: Column) -> Column:
    """The sum of a double column, the same in any order of its rows: equal sums are equal, and a table read twice has the same.

    Finite values are summed as decimals of 18 places; sums from 10^20 on raise an error. A value that is not finite makes the sum so.
    """
    decimals = F.sum(F.when(finite(c), c).cast("decimal(38,18)")).cast("double")
    odd = F.sum(F.when(~finite(c), c))
    return F.when(odd.isNull(), decimals).otherwise(odd)


def ranked(metrics: DataFrame, value: str, order: str, descending: bool = True, parts: int = 200) -> DataFrame:
    """``metrics`` with ``place``: stable by ``order``, nulls last either way.

    Values part at their percentiles into ranges, each ranked by itself behind the sizes of those before
    it: a task sorts a range, not the table. Equal values share a range.
    """
    v = F.col(value).cast("double")
    cuts = metrics.agg(F.percentile_approx(v, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>")
    beyond = F.size(F.filter(bounds, lambda c: (c > v) if descending else (c < v)))
    df = metrics.withColumn("_part", F.when(v.isNull(), parts).otherwise(beyond))
    sizes = df.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    first = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(first, order))
    return df.withColumn("place", place).join(F.broadcast(sizes), "_part").withColumn("place", F.col("place") + F.col("_before")).drop("_part", "_before")  # at most parts + 1 rows


def merged_summaries(rows: DataFrame, key: str, source: str, value: str) -> DataFrame:
    """One value a key and source, with ``conflict`` where sources disagree."""
    return rows.groupBy(key, source).agg(F.min(value).alias("value"), (F.count_distinct(value) > 1).alias("conflict"))


def status_counts(rows: DataFrame, status: Column, every: list[str]) -> DataFrame:
    """The number of rows of each status, also of those that do not occur."""
    spark = rows.sparkSession
    counts = rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, every))).alias("status"))
    return listed.join(counts, "status", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def fingerprint(df: DataFrame) -> DataFrame:
    """The number of rows and a sum of their hashes: equal for equal tables in any order."""
    hashed = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(hashed).alias("hash"))


#: What a column is to a report, as its metadata tells: the name of a class, how often it occurred, any other measure, a price, or a position in a series.
ROLES = ("category", "count", "measure", "price", "place")


def with_roles(df: DataFrame, **roles: str) -> DataFrame:
    """``df`` whose named columns carry their role in their metadata, from where every later projection keeps it."""
    if odd := sorted(set(roles.values()) - set(ROLES)) or sorted(set(roles) - set(df.columns)):
        raise ValueError(f"no such role or column: {odd}")
    return df.withColumns({c: F.col(c).alias(c, metadata=dict(df.schema[c].metadata, role=r)) for c, r in roles.items()})


def roles(df: DataFrame, key: str) -> dict[str, str | None]:
    """The role of each column but the key: as declared, else by type: times are places, numbers measures, and the rest is nothing."""
    def told(field: T.StructField) -> str | None:
        by_type = "place" if isinstance(field.dataType, T.DatetimeType) else "measure" if isinstance(field.dataType, T.NumericType) else None
        return field.metadata.get("role", by_type)

    return {f.name: told(f) for f in df.schema if f.name != key}


def inferred_metrics(tables: dict[str, DataFrame], key: str = "ticker", summaries: tuple[str, ...] = ()) -> DataFrame:
    """``(ticker, table, metric, value, aggregation)`` of result tables with a ``ticker`` column, by the roles of their columns.

    A table of one category and its count gives a sum for each category, for tickers whose
    categories are different and not blank and whose counts are whole and not negative. Any other table gives, for tickers with
    one row, its counts, which are summed over tickers, and its measures, which are only ranked. A table with a place is a
    series and gives nothing, unless it is one of ``summaries``.
    """
    schema, found = f"{key} string, table string, metric string, value double, aggregation string", []
    for name, df in tables.items():
        known, each = roles(df, key), Window.partitionBy(key)
        of = lambda r: [c for c, x in known.items() if x == r]
        if len(known) == 2 and len(of("category")) == len(of("count")) == 1:
            label, times = F.col(of("category")[0]).cast("string"), F.col(of("count")[0]).cast("double")
            sound = true(F.length(F.trim(label)) > 0) & F.coalesce(times == F.abs(F.floor(times)), times.isNull())
            alone = F.count("*").over(Window.partitionBy(key, label)) == 1
            rows = df.select(key, label.alias("metric"), times.alias("value"), (sound & alone).alias("_sound"))
            found.append(rows.withColumn("_all", F.min("_sound").over(each)).where("_all").select(key, F.lit(name).alias("table"), "metric", "value", F.lit("sum").alias("aggregation")))
        elif (of("count") or of("measure")) and (name in summaries or not of("place")):
            one = df.withColumn("_rows", F.count("*").over(each)).where("_rows = 1").select(key, *[F.col(c).cast("double").alias(c) for c in of("count") + of("measure")])
            long = one.unpivot(key, of("count") + of("measure"), "metric", "value").where("value is not null")
            found.append(long.select(key, F.lit(name).alias("table"), "metric", "value", F.when(F.col("metric").isin(of("count")), "sum").otherwise("none").alias("aggregation")))
    if found:
        return reduce(DataFrame.unionByName, found)
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([], schema)
