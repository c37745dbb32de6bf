"""Flat ranges and trends as bounded window jobs, and selections from candidate intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.indicators import numbered
from barspark.operators.spans import deviation, interval_extremes, interval_moments, pooled
from barspark.schema import by_time, ratio

ULPS = 1 + 1e-12


def flat_windows(bars: DataFrame, least: int, most: int, limit: float | None = None, percentile: float = 0.5, multiplier: float = 1.0, longest_bar: float | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """For each end bar the longest stretch of ``least`` to ``most`` bars whose range is within the limit.

    The width is 100 * (high - low) / mid. ``limit`` is a percentage, or None for
    ``multiplier`` times the ``percentile`` of the bars' own widths in the stretch. With
    ``longest_bar`` no bar may be wider than that many times their median. Each end bar sees
    only the ``most`` bars up to itself, as an array frame; no stretch spans two values of ``keys``. ``longest_bar_width``
    and ``median_bar_width`` are those of its bars, and ``limit`` is the width that it was allowed.
    """
    frame = by_time(*keys).rowsBetween(1 - most, 0)
    width = 200 * ratio(F.col("high") - F.col("low"), F.col("high") + F.col("low"))
    df = numbered(bars).withColumn("_w", width).withColumn("_seen", F.collect_list(F.struct("rn", "ts", "high", "low", F.col("_w").alias("w"))).over(frame))
    sizes = F.sequence(F.lit(most), F.lit(least), F.lit(-1))

    allowed = lambda widths: F.lit(limit) if limit is not None else multiplier * interpolated(widths, percentile)

    def fits(n: Column) -> Column:
        own = F.slice("_seen", -n, n)
        top, bottom = F.array_max(F.transform(own, lambda x: x["high"])), F.array_min(F.transform(own, lambda x: x["low"]))
        span = 200 * ratio(top - bottom, top + bottom)
        widths = F.sort_array(F.transform(own, lambda x: x["w"]))
        bound = allowed(widths)
        ok = span <= bound * ULPS
        if longest_bar is not None:
            ok = ok & (F.array_max(widths) <= longest_bar * interpolated(widths, 0.5) * ULPS)
        return ok

    ready = F.filter(sizes, lambda n: n <= F.size("_seen"))
    df = df.withColumn("bars", F.get(F.filter(ready, fits), F.lit(0))).where("bars is not null")
    own = F.expr("slice(_seen, -bars, bars)")
    df = df.withColumn("_own", own).withColumn("_widths", F.sort_array(F.transform("_own", lambda x: x["w"])))
    top, bottom = F.array_max(F.transform("_own", lambda x: x["high"])), F.array_min(F.transform("_own", lambda x: x["low"]))
    return df.select(
        "symbol", F.get("_own", F.lit(0))["ts"].alias("start_ts"), F.col("ts").alias("end_ts"), (F.col("rn") - F.col("bars") + 1).alias("start_rn"), F.col("rn").alias("end_rn"), "bars",
        top.alias("upper"), bottom.alias("lower"), ((top + bottom) / 2).alias("mid"), (200 * (top - bottom) / (top + bottom)).alias("width"),
        allowed(F.col("_widths")).alias("limit"), F.array_max("_widths").alias("longest_bar_width"), interpolated(F.col("_widths"), 0.5).alias("median_bar_width"),
    )


def interpolated(values: Column, q: float) -> Column:
    """The linear percentile of a sorted array."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (at - low)


def current_flat(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """The stretch that ends at the symbol's last bar, if there is one."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("end_ts"))
    return windows.join(last, ["symbol", "end_ts"], "left_semi")


def disjoint_latest(windows: DataFrame) -> DataFrame:
    """Disjoint stretches of each symbol: the latest end, then the latest that ends before its start, and so on.

    Candidates first part into islands that overlap, so what one fold walks over is one
    island, not a whole series.
    """
    order = Window.partitionBy("symbol").orderBy("start_rn", "end_rn")
    reach = F.max("end_rn").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("start_rn") > reach)).cast("int")
    islands = windows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
    one = islands.groupBy("symbol", "_island").agg(F.sort_array(F.collect_list(F.struct((-F.col("end_rn")).alias("e"), "start_rn"))).alias("_all"))
    empty = F.struct(F.lit(1 << 60).cast("long").alias("cursor"), F.array().cast("array<long>").alias("ends"))
    step = lambda s, x: F.when(-x["e"] < s["cursor"], F.struct(x["start_rn"].cast("long").alias("cursor"), F.concat(s["ends"], F.array((-x["e"]).cast("long"))).alias("ends"))).otherwise(s)
    kept = one.select("symbol", F.explode(F.aggregate("_all", empty, step)["ends"]).alias("end_rn"))
    return windows.join(kept, ["symbol", "end_rn"], "left_semi")


def flat_statistics(periods: DataFrame, bars: DataFrame, factor: float = 1.01, by: str = "rn") -> DataFrame:
    """Of each distinct period, given by ``start_<by>`` and ``end_<by>``: bars, red ones, those above ``open * factor``, and ``moves``, the moments of its returns, of which its first bar gives none.

    ``volatility`` is their deviation in percent. Periods of any length cost the same.
    """
    rows = numbered(bars).withColumn("rn", F.col("rn").cast("long"))
    before = F.lag("close").over(by_time())
    red, above = F.col("close") < F.col("open"), F.col("high") > F.col("open") * factor
    counts = {"bars": F.lit(True), "red": red, "red_above": red & above, "red_below": red & ~above, "above": above}
    rows = rows.withColumn("_r", ratio(F.col("close"), before) - 1)
    found = interval_moments(rows, periods, by, counts, steps={"moves": F.col("_r")})
    return found.withColumns({"volatility": 100 * deviation("moves"), "returns": F.col("moves.n")})


def pooled_statistics(statistics: DataFrame) -> DataFrame:
    """Rows of :func:`flat_statistics` as one by symbol: periods, counts, the share of red bars that go above, and the volatility of all their returns together."""
    counts = ("bars", "red", "red_above", "red_below", "above")
    found = statistics.groupBy("symbol").agg(F.count("*").alias("periods"), *[F.sum(c).alias(c) for c in counts], pooled("moves"))
    return found.withColumns({"red_above_share": ratio(F.col("red_above"), F.col("red")), "returns": F.col("moves.n"), "volatility": 100 * deviation("moves")})


# Weights of the least-squares, pair-slope, ordering and efficiency parts of the evidence; the least length of a
# stretch, and the part of a length by which its start is moved to test it; the bars and the deviations of a young counter-move.
WEIGHTS = (0.25, 0.20, 0.35, 0.20)
LEAST_LENGTH, MOVED = 8, 0.05
YOUNG_BARS, SHOCK = 5, 2.0


def moved_lengths(n: int, least: int = LEAST_LENGTH, part: float = MOVED) -> list[int]:
    """The lengths of a stretch of ``n`` bars whose start is moved by ``part`` of it, and by half of that, either way."""
    h = max(1, round(part * n)) if part > 0 else 0
    return sorted({x for x in (n - h, n - h // 2, n, n + h // 2, n + h) if x >= least})


def pair_slopes(xs: Column, n: int) -> Column:
    """The slopes of all pairs of the ``n`` values of an array, one step apart each."""
    return F.flatten(F.transform(xs, lambda x, i: F.transform(F.slice(xs, i + 2, F.lit(n)), lambda y, k: (y - x) / (k + 1))))


def trend_evidence(bars: DataFrame, lookbacks: tuple[int, ...] = (8, 16, 32), weights: tuple[float, float, float, float] = WEIGHTS, least_support: float = 0.55, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Evidence of a trend over each declared lookback that ends at each bar, on log closes.

    ``slope`` and ``r2`` of least squares, ``robust`` (the median slope of all pairs), ``sigma`` (the
    sample deviation of returns, at least 1e-8), ``efficiency`` (net move over path), ``ordering``
    (rising minus falling pairs over all pairs), ``z`` and ``magnitude`` (either slope, times the root of
    the number of returns, over sigma), ``clarity`` and ``direction`` of the weighted ``evidence``, and ``boundary``:
    the share of moved starts whose evidence keeps the direction and reaches ``least_support``. Over a
    constant price all slopes are 0. Intervals come from the declared ladder, not from a penalised
    optimum. A bar sees the longest lookback and its moved starts as one array frame. No interval spans two values of ``keys``.
    """
    lengths = sorted({m for n in lookbacks for m in moved_lengths(n)})
    most = lengths[-1]
    w = by_time(*keys)
    df = numbered(bars).withColumn("_place", F.row_number().over(w)).withColumn("_x", F.log("close")).withColumn("_r", F.col("_x") - F.lag("_x").over(w))
    df = df.withColumn("_xs", F.collect_list("_x").over(w.rowsBetween(1 - most, 0)))
    table = []
    for n in lengths:
        span, moves = w.rowsBetween(1 - n, 0), w.rowsBetween(2 - n, 0)
        flat = (F.max("_x").over(span) - F.min("_x").over(span)) < 1e-13
        sigma = F.greatest(F.stddev_samp("_r").over(moves), F.lit(1e-8))
        df = df.withColumns({
            f"_flat{n}": flat, f"_slope{n}": F.when(flat, 0.0).otherwise(F.regr_slope("_x", "rn").over(span)), f"_r2{n}": F.when(flat, 0.0).otherwise(F.coalesce(F.regr_r2("_x", "rn").over(span), F.lit(0.0))),
            f"_sigma{n}": sigma, f"_eff{n}": F.coalesce(ratio(F.sum("_r").over(moves), F.sum(F.abs("_r")).over(moves)), F.lit(0.0)),
        })
        df = df.withColumn(f"_pairs{n}", F.when(F.col("_place") >= n, F.sort_array(pair_slopes(F.slice("_xs", -n, n), n))))
        root = F.sqrt(F.lit(float(n - 1)))
        robust = F.when(F.col(f"_flat{n}"), 0.0).otherwise(interpolated(F.col(f"_pairs{n}"), 0.5))
        ordering = F.aggregate(f"_pairs{n}", F.lit(0.0), lambda t, x: t + F.signum(x)) / (n * (n - 1) / 2)
        df = df.withColumns({f"_robust{n}": robust, f"_ord{n}": ordering})
        z, magnitude = F.col(f"_slope{n}") * root / F.col(f"_sigma{n}"), F.col(f"_robust{n}") * root / F.col(f"_sigma{n}")
        parts = (F.col(f"_r2{n}") * F.tanh(z / 2), F.tanh(magnitude / 2), F.col(f"_ord{n}"), F.col(f"_eff{n}"))
        evidence = sum((a * x for a, x in zip(weights[1:], parts[1:])), weights[0] * parts[0])
        df = df.withColumns({f"_z{n}": z, f"_mag{n}": F.abs(magnitude), f"_ev{n}": evidence}).drop(f"_pairs{n}")
    for n in lookbacks:
        direction = F.signum(f"_ev{n}")
        tried = [F.when(F.col("_place") >= m, ((direction * F.col(f"_ev{m}") >= least_support) & (direction * F.col(f"_robust{m}") > 0)).cast("double")) for m in moved_lengths(n)]
        held = sum((F.coalesce(x, F.lit(0.0)) for x in tried), F.lit(0.0))
        boundary = F.coalesce(ratio(held, sum((x.isNotNull().cast("int") for x in tried), F.lit(0))), F.lit(0.0))
        table.append(F.struct(
            F.lit(n).alias("lookback"), *[F.col(f"_{c}{n}").alias(name) for c, name in (("slope", "slope"), ("r2", "r2"), ("robust", "robust"), ("sigma", "sigma"), ("eff", "efficiency"), ("ord", "ordering"), ("z", "z"), ("mag", "magnitude"), ("ev", "evidence"))],
            F.abs(f"_ev{n}").alias("clarity"), direction.alias("direction"), boundary.alias("boundary"), F.expm1(f"_robust{n}").alias("rate"),
        ))
    found = df.select("symbol", "ts", "rn", "_place", F.inline(F.array(*table)))
    return found.where("_place >= lookback").drop("_place")


def trend_gates(evidence: DataFrame, clarity: float = 0.65, magnitude: float = 1.0, boundary: float = 0.80) -> DataFrame:
    """``evidence`` with ``accepted`` and ``reasons`` against it."""
    against = [
        F.when(F.col("clarity") < clarity, "clarity"), F.when(F.col("magnitude") < magnitude, "magnitude"),
        F.when(F.col("direction") * F.col("robust") <= 0, "slope disagrees"), F.when(F.col("boundary") < boundary, "boundary"),
    ]
    reasons = F.concat_ws(", ", *against)
    return evidence.withColumns({"accepted": reasons == "", "reasons": reasons})


def countertrends(accepted: DataFrame) -> DataFrame:
    """``accepted`` with ``countertrend``: a longer accepted interval that ends with it runs the other way."""
    longer = accepted.groupBy("symbol", "rn").agg(F.max_by("direction", "lookback").alias("_d"), F.max("lookback").alias("_n"))
    return accepted.join(longer, ["symbol", "rn"]).withColumn("countertrend", (F.col("_n") > F.col("lookback")) & (F.col("_d") != F.col("direction"))).drop("_d", "_n")


def trend_records(accepted: DataFrame, bars: DataFrame, young_bars: int = YOUNG_BARS, shock: float = SHOCK) -> DataFrame:
    """Rows of :func:`trend_evidence` as records of their intervals.

    Start, end and duration, direction, ``rate`` a bar, ``movement`` (of log closes from the start to the extreme in the
    direction), ``retreat`` (from there to the end), ``retracement``, their ratio, ``young``: the bars since the extreme,
    ``shock``: the retreat in deviations of so many returns, and ``abrupt``: a counter-move of fewer than ``young_bars`` bars that reaches ``shock``.
    """
    rows = numbered(bars).withColumn("rn", F.col("rn").cast("long"))
    trends = accepted.withColumns({"start_rn": (F.col("rn") - F.col("lookback") + 1).cast("long"), "end_rn": F.col("rn").cast("long")})
    longest = accepted.agg(F.max("lookback")).first()[0] or 1
    found = trends.join(interval_extremes(rows, trends, F.log("close"), longest), ["symbol", "start_rn", "end_rn"])
    found = found.join(rows.select("symbol", F.col("rn").alias("start_rn"), F.col("ts").alias("start_ts")), ["symbol", "start_rn"])
    falls = F.col("direction") < 0
    movement = F.greatest(F.lit(0.0), F.when(falls, F.col("first") - F.col("low")).otherwise(F.col("top") - F.col("first")))
    retreat = F.greatest(F.lit(0.0), F.when(falls, F.col("last") - F.col("low")).otherwise(F.col("top") - F.col("last")))
    found = found.withColumns({"movement": movement, "retreat": retreat, "young": F.col("end_rn") - F.when(falls, F.col("low_rn")).otherwise(F.col("top_rn"))})
    found = found.withColumns({"retracement": F.col("retreat") / F.greatest(F.col("movement"), F.lit(1e-12)), "shock": F.col("retreat") / (F.col("sigma") * F.sqrt(F.greatest(F.lit(1.0), F.col("young").cast("double"))))})
    abrupt = (F.col("young") > 0) & (F.col("young") < young_bars) & (F.col("shock") >= shock)
    return found.select("symbol", "start_ts", F.col("ts").alias("end_ts"), "start_rn", "end_rn", F.col("lookback").alias("duration"), "direction", "clarity", F.expm1("slope").alias("rate"), "movement", "retreat", "retracement", "young", "shock", abrupt.alias("abrupt"))
