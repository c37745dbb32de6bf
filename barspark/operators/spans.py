"""Totals, moments and extremes over any intervals of a series, without a row for each bar of each interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


EXACT = "decimal(38, 20)"


def interval_moments(bars: DataFrame, periods: DataFrame, by: str, counts: dict[str, Column], inside: dict[str, Column] | None = None, steps: dict[str, Column] | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The distinct ``periods(*keys, start_<by>, end_<by>)``, ends included, with totals over the bars in each.

    ``counts``: conditions, each to the number of bars for which it holds. ``inside``: values, and ``steps``: values
    that belong to a bar and the one before it, so that a period's first bar gives none; each to
    a struct ``(n, s, q, centre)``: their number, and the sum and the sum of squares of their distances from ``centre``, about the series' median.
    :func:`mean` and :func:`deviation` read it; structs of one series add up by :func:`pooled`. Running sums are
    decimals of 20 places, so that a short quiet period after a wild one loses nothing; sums from 10^18 on raise an error.

    A bar carries running totals; a period takes those as of its two ends and subtracts. Bars and ends are
    one union in order of time, so a series is sorted once and nothing is joined on the series alone.
    """
    order, whole = Window.partitionBy(*keys).orderBy(by), Window.partitionBy(*keys)
    through, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, 1)
    inside, steps = inside or {}, steps or {}
    df = bars.select(*keys, by, *[c.alias(f"_v_{n}") for n, c in (inside | steps).items()], *[F.coalesce(c, F.lit(False)).cast("long").alias(f"_c_{n}") for n, c in counts.items()])
    df = df.withColumns({f"_m_{n}": F.percentile_approx(f"_v_{n}", 0.5).over(whole) for n in inside | steps})  # not the mean, which a wild value draws away

    def moments(n: str, frame) -> list[Column]:
        far = F.col(f"_v_{n}") - F.col(f"_m_{n}")
        total = lambda x: F.coalesce(F.sum(x.cast(EXACT)).over(frame), F.lit(0).cast(EXACT))
        return [F.count(far).over(frame).alias("n"), total(far).alias("s"), total(far * far).alias("q")]

    total = [F.sum(f"_c_{n}").over(through).alias(n) for n in counts]
    total += [F.struct(*moments(n, through), F.col(f"_m_{n}").alias("centre")).alias(n) for n in inside]
    total += [F.struct(*moments(n, through), F.struct(*moments(n, ahead)).alias("next"), F.col(f"_m_{n}").alias("centre")).alias(n) for n in steps]
    rows = df.select(*keys, F.col(by).alias("_at"), F.lit(1).alias("_kind"), F.struct(*total).alias("_total"))
    ends = periods.select(*keys, f"start_{by}", f"end_{by}").distinct()
    nothing = F.lit(None).cast(rows.schema["_total"].dataType)
    marks = ends.select(*keys, f"start_{by}", f"end_{by}", F.inline(F.array(F.struct(F.col(f"start_{by}").alias("_at"), F.lit(0).alias("_kind")), F.struct(F.col(f"end_{by}").alias("_at"), F.lit(2).alias("_kind")))))
    both = rows.unionByName(marks.withColumn("_total", nothing), allowMissingColumns=True)
    last = F.last("_total", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_seen", last).where("_kind <> 1").groupBy(*keys, f"start_{by}", f"end_{by}")
    found = found.agg(F.first(F.when(F.col("_kind") == 0, F.col("_seen")), ignorenulls=True).alias("a"), F.first(F.when(F.col("_kind") == 2, F.col("_seen")), ignorenulls=True).alias("b"))

    def between(n: str, start: str) -> Column:
        b, a = F.col("b").getField(n), F.col("a").getField(n)
        low = a.getField(start) if start else a
        n_, s, q = (F.coalesce(b.getField(x), F.lit(0)) - F.coalesce(low.getField(x), F.lit(0)) for x in "nsq")
        return F.struct(n_.alias("n"), s.cast("double").alias("s"), q.cast("double").alias("q"), b.getField("centre").alias("centre")).alias(n)

    taken = [(F.coalesce(F.col("b").getField(n), F.lit(0)) - F.coalesce(F.col("a").getField(n), F.lit(0))).alias(n) for n in counts]
    taken += [between(n, "") for n in inside]
    # a period that holds no bar has no step; one that starts a series has the step into its first bar, which is null
    taken += [F.when(F.col("b").isNotNull(), between(n, "next")).alias(n) for n in steps]
    return found.select(*keys, f"start_{by}", f"end_{by}", *taken)


def mean(moments: str) -> Column:
    m = F.col(moments)
    return m["centre"] + F.try_divide(m["s"], m["n"])


def deviation(moments: str) -> Column:
    """The population deviation; null without a value."""
    m = F.col(moments)
    part = m["s"] / m["n"]
    return F.when(m["n"] == 1, 0.0).when(m["n"] > 1, F.sqrt(F.greatest(m["q"] / m["n"] - part * part, F.lit(0.0))))


def pooled(name: str) -> Column:
    """An aggregate: the moments of several periods of one series as one."""
    m = F.col(name)
    return F.struct(F.coalesce(F.sum(m["n"]), F.lit(0)).alias("n"), F.coalesce(F.sum(m["s"]), F.lit(0.0)).alias("s"), F.coalesce(F.sum(m["q"]), F.lit(0.0)).alias("q"), F.max(m["centre"]).alias("centre")).alias(name)


def interval_extremes(bars: DataFrame, intervals: DataFrame, value: Column, longest: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The distinct ``intervals(*keys, start_rn, end_rn)`` of up to ``longest`` bars with ``first``, ``last``, ``top``, ``top_rn``, ``low`` and ``low_rn`` of ``value``.

    Ties go to the earlier bar. A bar has the extremes of the 1, 2, 4, ... bars up to itself, each level made of two of
    the one below; an interval is covered by two stretches of the greatest power of two that fits.
    ``bars`` are numbered by ``rn`` from 1 without a gap.
    """
    order = Window.partitionBy(*keys).orderBy("rn")
    df = bars.select(*keys, F.col("rn").cast("long").alias("rn"), value.alias("_v"))
    df = df.withColumn("_0", F.struct(F.struct(F.col("_v").alias("x"), (-F.col("rn")).alias("r")).alias("up"), F.struct((-F.col("_v")).alias("x"), (-F.col("rn")).alias("r")).alias("down")))
    levels = max(longest, 1).bit_length()
    for k in range(1, levels):
        before = F.coalesce(F.lag(f"_{k - 1}", 1 << (k - 1)).over(order), F.col(f"_{k - 1}"))
        df = df.withColumn(f"_{k}", F.struct(*[F.greatest(F.col(f"_{k - 1}").getField(x), before.getField(x)).alias(x) for x in ("up", "down")]))
    table = df.select(*keys, "rn", "_v", F.array(*[f"_{k}" for k in range(levels)]).alias("_levels"))
    one = intervals.select(*keys, F.col("start_rn").cast("long").alias("start_rn"), F.col("end_rn").cast("long").alias("end_rn")).distinct()
    one = one.withColumn("_k", F.floor(F.log2((F.col("end_rn") - F.col("start_rn") + 1).cast("double")) + 1e-12).cast("int"))
    inner = F.expr("start_rn + shiftleft(1L, _k) - 1")
    place = lambda rn, what: F.struct(rn.alias("rn"), F.lit(what).alias("_what"))
    asked = one.select(*keys, "start_rn", "end_rn", "_k", F.inline(F.array(place(F.col("start_rn"), 0), place(inner, 1), place(F.col("end_rn"), 2))))
    met = asked.join(table, [*keys, "rn"]).withColumn("_level", F.when(F.col("_what") > 0, F.get("_levels", F.col("_k"))))
    found = met.groupBy(*keys, "start_rn", "end_rn").agg(
        F.max(F.when(F.col("_what") == 0, F.col("_v"))).alias("first"), F.max(F.when(F.col("_what") == 2, F.col("_v"))).alias("last"), F.max("_level.up").alias("_up"), F.max("_level.down").alias("_down"),
    )
    return found.select(*keys, "start_rn", "end_rn", "first", "last", F.col("_up.x").alias("top"), (-F.col("_up.r")).alias("top_rn"), (-F.col("_down.x")).alias("low"), (-F.col("_down.r")).alias("low_rn"))
