"""Queries on indicators, factors and schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.functions import described
from barspark.functions import indicators as ind
from barspark.operators import strategy
from barspark.plans import strategies
from barspark.plans.pipeline import Contract, registry
from barspark.queries import NUMBERED_SQL, event_bars_sql, query, ship_bars_sql
from barspark.schema import by_time
from barspark.sources.bars import event_bars, ship_bars

H = event_bars_sql("hour")
W = ship_bars_sql("week", True)
P = "PARTITION BY symbol ORDER BY ts"


def rounded(df, *names, t=True):
    lead = ["symbol"] + ([F.unix_seconds("ts").alias("t")] if t else [])
    return df.select(*lead, *[F.round(c, 6).alias(c) for c in names])


def out(*names: str) -> str:
    return "symbol, epoch(ts)::BIGINT AS t, " + ", ".join(f"round({n}, 6) AS {n}" for n in names)


def scan(name: str, source: str, first: int, keep: float, value: str) -> str:
    """A recursive twin of the affine scan: ``value`` at row ``first``, then keep * previous + value."""
    rows = f"(SELECT symbol, rn, ({value})::DOUBLE AS v FROM {source})"
    return f"""{name}(symbol, rn, {name}) AS (SELECT symbol, rn, v FROM {rows} WHERE rn = {first}
  UNION ALL SELECT s.symbol, s.rn, {keep!r} * y.{name} + s.v FROM {name} y JOIN {rows} s ON s.symbol = y.symbol AND s.rn = y.rn + 1)"""


def ema_sql(name: str, source: str, price: str, period: int, first: int | None = None) -> str:
    first = first or period
    mean = f"m_{name}"
    a = 2 / (period + 1)
    return f"{mean} AS (SELECT *, avg({price}) OVER ({P} ROWS {period - 1} PRECEDING) AS mean FROM {source}), " + scan(name, mean, first, 1 - a, f"CASE WHEN rn = {first} THEN mean ELSE {a!r} * {price} END")


def wilder_sql(name: str, source: str, x: str, first: int, period: int) -> str:
    mean = f"m_{name}"
    return f"{mean} AS (SELECT *, avg({x}) OVER ({P} ROWS {period - 1} PRECEDING) AS mean FROM {source}), " + scan(name, mean, first, 1 - 1 / period, f"CASE WHEN rn = {first} THEN mean ELSE {x} / {period} END")


def bars(spark, sf_dir):
    return ind.numbered(event_bars(spark, sf_dir))


@query(f"WITH {H}, {NUMBERED_SQL} SELECT {out('sma')} FROM (SELECT *, CASE WHEN rn >= 20 THEN avg(close) OVER ({P} ROWS 19 PRECEDING) END AS sma FROM numbered)")
def e01_sma(spark, sf_dir):
    return rounded(bars(spark, sf_dir).withColumn("sma", ind.sma("close", 20)), "sma")


@query(f"WITH {H}, {NUMBERED_SQL} SELECT {out('wma')} FROM (SELECT *, (" + " + ".join(f"{10 - k} * lag(close, {k}) OVER ({P})" for k in range(10)) + ") / 55 AS wma FROM numbered)")
def e02_wma(spark, sf_dir):
    return rounded(bars(spark, sf_dir).withColumn("wma", ind.wma("close", 10)), "wma")


@query(f"WITH RECURSIVE {H}, {NUMBERED_SQL}, {ema_sql('ema', 'numbered', 'close', 12)} SELECT {out('ema')} FROM numbered LEFT JOIN ema USING (symbol, rn)")
def e03_ema(spark, sf_dir):
    return rounded(ind.ema(bars(spark, sf_dir), 12), "ema")


_CHANGES = f"changes AS (SELECT *, CASE WHEN rn > 1 THEN greatest(close - p, 0) END AS gain, CASE WHEN rn > 1 THEN greatest(p - close, 0) END AS loss FROM (SELECT *, lag(close) OVER ({P}) AS p FROM numbered))"


@query(f"WITH RECURSIVE {H}, {NUMBERED_SQL}, {_CHANGES}, {wilder_sql('up', 'changes', 'gain', 15, 14)}, {wilder_sql('down', 'changes', 'loss', 15, 14)} SELECT {out('rsi')} FROM (SELECT n.*, CASE WHEN up + down = 0 THEN 0 ELSE 100 * up / (up + down) END AS rsi FROM numbered n LEFT JOIN up USING (symbol, rn) LEFT JOIN down USING (symbol, rn))")
def e04_rsi(spark, sf_dir):
    return rounded(ind.rsi(bars(spark, sf_dir)), "rsi")


@query(f"WITH RECURSIVE {H}, {NUMBERED_SQL}, {ema_sql('fast', 'numbered', 'close', 12, 26)}, {ema_sql('slow', 'numbered', 'close', 26)}, lined AS (SELECT n.symbol, n.rn, n.ts, fast - slow AS line FROM numbered n JOIN fast USING (symbol, rn) JOIN slow USING (symbol, rn)), {ema_sql('sig', 'lined', 'line', 9, 34)} SELECT {out('macd', 'macd_signal', 'macd_histogram')} FROM (SELECT n.*, CASE WHEN n.rn >= 34 THEN line END AS macd, sig AS macd_signal, line - sig AS macd_histogram FROM numbered n LEFT JOIN lined USING (symbol, rn) LEFT JOIN sig USING (symbol, rn))")
def e05_macd(spark, sf_dir):
    return rounded(ind.macd(bars(spark, sf_dir)), "macd", "macd_signal", "macd_histogram")


_RANGE = f"ranged AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS tr FROM (SELECT *, lag(close) OVER ({P}) AS p, high - lag(high) OVER ({P}) AS up, lag(low) OVER ({P}) - low AS down FROM numbered))"


@query(f"WITH RECURSIVE {H}, {NUMBERED_SQL}, {_RANGE}, {wilder_sql('atr', 'ranged', 'tr', 15, 14)} SELECT {out('atr', 'natr')} FROM (SELECT *, 100 * atr / close AS natr FROM numbered LEFT JOIN atr USING (symbol, rn))")
def e06_atr(spark, sf_dir):
    return rounded(ind.atr(bars(spark, sf_dir)), "atr", "natr")


@query(f"WITH {H}, {NUMBERED_SQL} SELECT {out('band_upper', 'band_middle', 'band_lower')} FROM (SELECT *, CASE WHEN rn >= 20 THEN m + 2 * s END AS band_upper, CASE WHEN rn >= 20 THEN m END AS band_middle, CASE WHEN rn >= 20 THEN m - 2 * s END AS band_lower FROM (SELECT *, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s FROM numbered WINDOW w AS ({P} ROWS 19 PRECEDING)))")
def e07_bollinger(spark, sf_dir):
    return rounded(bars(spark, sf_dir).withColumns(ind.bollinger("close", 20)), "band_upper", "band_middle", "band_lower")


_MOVES = "moved AS (SELECT *, CASE WHEN p IS NOT NULL THEN CASE WHEN up > down AND up > 0 THEN up ELSE 0 END END AS plus, CASE WHEN p IS NOT NULL THEN CASE WHEN down > up AND down > 0 THEN down ELSE 0 END END AS minus FROM ranged)"
_SUMS = ", ".join(
    f"m_{n} AS (SELECT *, sum({x}) OVER ({P} ROWS 13 PRECEDING) AS first_sum FROM moved), " + scan(n, f"m_{n}", 14, 1 - 1 / 14, f"CASE WHEN rn = 14 THEN first_sum ELSE {x} END")
    for n, x in (("splus", "plus"), ("sminus", "minus"), ("srange", "tr"))
)


@query(f"""WITH RECURSIVE {H}, {NUMBERED_SQL}, {_RANGE}, {_MOVES}, {_SUMS}, dis AS (
  SELECT n.*, CASE WHEN n.rn >= 15 THEN 100 * splus / srange END AS plus_di, CASE WHEN n.rn >= 15 THEN 100 * sminus / srange END AS minus_di
  FROM numbered n LEFT JOIN splus USING (symbol, rn) LEFT JOIN sminus USING (symbol, rn) LEFT JOIN srange USING (symbol, rn)
), dxs AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di) AS dx FROM dis), {wilder_sql('adx', 'dxs', 'dx', 28, 14)}
SELECT {out('plus_di', 'minus_di', 'adx')} FROM dis LEFT JOIN adx USING (symbol, rn)""")
def e08_adx(spark, sf_dir):
    return rounded(ind.adx(bars(spark, sf_dir)), "plus_di", "minus_di", "adx")


@query(f"WITH {H}, {NUMBERED_SQL}, k AS (SELECT *, CASE WHEN hi = lo THEN 0 ELSE 100 * (close - lo) / (hi - lo) END AS k FROM (SELECT *, min(low) OVER w AS lo, max(high) OVER w AS hi FROM numbered WINDOW w AS ({P} ROWS 13 PRECEDING))), s AS (SELECT *, avg(k) OVER ({P} ROWS 2 PRECEDING) AS sk FROM k) SELECT {out('slow_k', 'slow_d')} FROM (SELECT *, CASE WHEN rn >= 18 THEN sk END AS slow_k, CASE WHEN rn >= 18 THEN avg(sk) OVER ({P} ROWS 2 PRECEDING) END AS slow_d FROM s)")
def e09_stochastic(spark, sf_dir):
    return rounded(ind.stochastic(bars(spark, sf_dir)), "slow_k", "slow_d")


@query(f"WITH {H}, s AS (SELECT *, coalesce(sign(close - lag(close) OVER ({P})), 1) * volume AS v FROM bars) SELECT {out('obv')} FROM (SELECT *, sum(v) OVER ({P} ROWS UNBOUNDED PRECEDING) AS obv FROM s)")
def e10_obv(spark, sf_dir):
    return rounded(ind.with_obv(bars(spark, sf_dir)), "obv")


_FACTORS = f"""factors AS (SELECT symbol, ts, rn, close, open, high, CASE WHEN rn > 8 THEN close / lag(close, 8) OVER ({P}) - 1 END AS momentum,
  CASE WHEN rn > 8 THEN stddev_pop(r) OVER ({P} ROWS 7 PRECEDING) END AS volatility,
  CASE WHEN rn >= 8 THEN avg(CASE WHEN close < open THEN (high - open) / high END) OVER ({P} ROWS 7 PRECEDING) END AS red
  FROM (SELECT *, close / lag(close) OVER ({P}) - 1 AS r FROM numbered))"""
_PANEL = f"""WITH {W}, {NUMBERED_SQL}, {_FACTORS}, complete AS (SELECT *, momentum IS NOT NULL AND volatility IS NOT NULL AND red IS NOT NULL AS ok FROM factors), ranked AS (
  SELECT *, (rank() OVER (PARTITION BY ts ORDER BY momentum) + (count(*) OVER (PARTITION BY ts, momentum) - 1) / 2) / count(*) OVER (PARTITION BY ts) AS r1,
    (rank() OVER (PARTITION BY ts ORDER BY -volatility) + (count(*) OVER (PARTITION BY ts, volatility) - 1) / 2) / count(*) OVER (PARTITION BY ts) AS r2,
    (rank() OVER (PARTITION BY ts ORDER BY red) + (count(*) OVER (PARTITION BY ts, red) - 1) / 2) / count(*) OVER (PARTITION BY ts) AS r3
  FROM complete WHERE ok), panel AS (SELECT c.*, round(0.5 * r1 + 0.3 * r2 + 0.2 * r3, 12) AS score FROM complete c LEFT JOIN ranked r USING (symbol, ts))"""


def panel(spark, sf_dir):
    return strategy.scored_panel(strategy.factor_panel(ship_bars(spark, sf_dir, "week", True), 8), {"momentum": (1, 0.5), "volatility": (-1, 0.3), "red": (1, 0.2)})


@query(f"WITH {W}, {NUMBERED_SQL}, {_FACTORS} SELECT {out('momentum', 'volatility', 'red')} FROM factors")
def j01_factor_panel(spark, sf_dir):
    return rounded(strategy.factor_panel(ship_bars(spark, sf_dir, "week", True), 8), "momentum", "volatility", "red")


@query(f"{_PANEL} SELECT {out('score')} FROM panel")
def e16_scores(spark, sf_dir):
    return rounded(panel(spark, sf_dir), "score")


@query(f"WITH {H}, {NUMBERED_SQL}, a AS (SELECT *, CASE WHEN rn >= 5 THEN avg(close) OVER ({P} ROWS 4 PRECEDING) END AS f, CASE WHEN rn >= 12 THEN avg(close) OVER ({P} ROWS 11 PRECEDING) END AS s FROM numbered), b AS (SELECT *, lag(f) OVER ({P}) AS pf, lag(s) OVER ({P}) AS ps FROM a) SELECT symbol, epoch(ts)::BIGINT AS t, coalesce(f > s AND pf <= ps, false) AS up, coalesce(f < s AND pf >= ps, false) AS down FROM b")
def e20_crossings(spark, sf_dir):
    df = bars(spark, sf_dir).withColumns({"f": ind.sma("close", 5), "s": ind.sma("close", 12)})
    return df.select("symbol", F.unix_seconds("ts").alias("t"), ind.crossed_above("f", "s").alias("up"), ind.crossed_below("f", "s").alias("down"))


@query(f"WITH {H}, {NUMBERED_SQL} SELECT symbol, epoch(ts)::BIGINT AS t, row_number() OVER ({P}) - 1 - count(*) FILTER (ts < TIMESTAMP '2024-01-08') OVER (PARTITION BY symbol) AS source_index FROM numbered")
def e21_source_ordinals(spark, sf_dir):
    return strategy.source_index(event_bars(spark, sf_dir), "2024-01-08").select("symbol", F.unix_seconds("ts").alias("t"), "source_index")


_TARGETS = f"""targets AS (SELECT *, CASE WHEN rn >= 12 AND f > s THEN 1.0 ELSE 0.0 END AS cross_weight, CASE WHEN rn > 6 AND close > lag(close, 6) OVER ({P}) THEN 1.0 ELSE 0.0 END AS momentum_weight FROM (
  SELECT *, avg(close) OVER ({P} ROWS 4 PRECEDING) AS f, avg(close) OVER ({P} ROWS 11 PRECEDING) AS s FROM numbered))"""


def targets(spark, sf_dir):
    return strategy.target_weights(event_bars(spark, sf_dir), fast=5, slow=12, lookback=6, weights=(0.6, 0.4))


@query(f"WITH {H}, {NUMBERED_SQL}, {_TARGETS} SELECT {out('cross_weight', 'momentum_weight', 'blend')} FROM (SELECT *, least(1.0, 0.6 * cross_weight + 0.4 * momentum_weight) AS blend FROM targets)")
def e25_strategy_weights(spark, sf_dir):
    return rounded(targets(spark, sf_dir), "cross_weight", "momentum_weight", "blend")


@query(f"WITH {H}, {NUMBERED_SQL}, {_TARGETS}, b AS (SELECT *, least(1.0, 0.6 * cross_weight + 0.4 * momentum_weight) AS blend FROM targets) SELECT {out('acting', 'next_open')} FROM (SELECT *, lag(blend) OVER ({P}) AS acting, lead(open) OVER ({P}) AS next_open FROM b)")
def e26_next_bar_execution(spark, sf_dir):
    return rounded(strategy.next_bar(targets(spark, sf_dir), "blend"), "acting", "next_open")


_CURVE = f"""moves AS (SELECT *, coalesce(lag(blend) OVER ({P}), 0) AS w, coalesce(close / lag(close) OVER ({P}) - 1, 0) AS r FROM (SELECT *, least(1.0, 0.6 * cross_weight + 0.4 * momentum_weight) AS blend FROM targets)), curve AS (
  SELECT *, 1000 * exp(sum(ln(1 + w * r)) OVER ({P} ROWS UNBOUNDED PRECEDING)) AS equity FROM moves)"""


@query(f"WITH {H}, {NUMBERED_SQL}, {_TARGETS}, {_CURVE} SELECT {out('equity')} FROM curve")
def j17_equity_curve(spark, sf_dir):
    return rounded(strategy.equity_curve(targets(spark, sf_dir), "blend", 1000.0), "equity")


@query(f"""WITH {H}, {NUMBERED_SQL}, {_TARGETS}, {_CURVE}, d AS (SELECT *, equity / max(equity) OVER ({P} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM curve), made AS (SELECT symbol, count(*) AS trade_count, sum(volume * close * 0.0005) AS total_fees FROM bars WHERE close > 2 * open GROUP BY 1)
SELECT d.symbol, round(first(equity ORDER BY ts), 6) AS initial, round(last(equity ORDER BY ts), 6) AS final, round(last(equity ORDER BY ts) / first(equity ORDER BY ts) - 1, 6) AS total_return, round(min(drawdown), 6) AS max_drawdown, coalesce(any_value(trade_count), 0) AS trade_count, round(coalesce(any_value(total_fees), 0), 6) AS total_fees FROM d LEFT JOIN made USING (symbol) GROUP BY d.symbol""")
def d18_performance(spark, sf_dir):
    trades = event_bars(spark, sf_dir).where("close > 2 * open").select("symbol", (F.col("volume") * F.col("close") * 0.0005).alias("fees"))
    found = strategy.performance(strategy.equity_curve(targets(spark, sf_dir), "blend", 1000.0), trades=trades)
    return found.select("symbol", "trade_count", *[F.round(c, 6).alias(c) for c in ("initial", "final", "total_return", "max_drawdown", "total_fees")])


@query(f"WITH {W}, d AS (SELECT DISTINCT ts FROM bars), l AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nx, row_number() OVER (ORDER BY ts) AS rn FROM d) SELECT epoch(ts)::BIGINT AS t, (rn - 1) % 4 = 0 AS every_n, coalesce(year(ts) <> year(nx) OR month(ts) <> month(nx), false) AS monthly, coalesce(isoyear(ts) <> isoyear(nx) OR week(ts) <> week(nx), false) AS weekly, coalesce(ts::DATE <> nx::DATE, false) AS daily FROM l")
def e27_rebalance_schedule(spark, sf_dir):
    closes = ship_bars(spark, sf_dir, "week", True).select("ts").distinct()
    return strategy.schedule(closes, every=4).select(F.unix_seconds("ts").alias("t"), "every_n", "monthly", "weekly", "daily")


@query(f"{_PANEL}, top AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS place FROM panel WHERE score IS NOT NULL) SELECT {out('score')}, place FROM top WHERE place <= 5")
def g02_top_n(spark, sf_dir):
    found = strategy.top_n(panel(spark, sf_dir), 5)
    return found.select("symbol", F.unix_seconds("ts").alias("t"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


_TOP = f"{_PANEL}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS place FROM panel WHERE score IS NOT NULL) WHERE place <= 5)"
_WEIGHTS = _TOP + """, weighed AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY ts) AS equal_weight, score / sum(score) OVER (PARTITION BY ts) AS score_weight,
  CASE WHEN volatility > 0 THEN 1 / volatility END / sum(CASE WHEN volatility > 0 THEN 1 / volatility END) OVER (PARTITION BY ts) AS inverse_volatility FROM top)"""


@query(f"{_WEIGHTS} SELECT {out('equal_weight', 'score_weight', 'inverse_volatility')} FROM weighed")
def j02_policies(spark, sf_dir):
    return rounded(strategy.policy_weights(strategy.top_n(panel(spark, sf_dir), 5)), "equal_weight", "score_weight", "inverse_volatility")


@query(f"""{_WEIGHTS}, ordered AS (SELECT *, inverse_volatility AS w, row_number() OVER (PARTITION BY ts ORDER BY inverse_volatility DESC, symbol) AS k, count(*) OVER (PARTITION BY ts) AS n FROM weighed WHERE inverse_volatility IS NOT NULL), tails AS (
  SELECT *, sum(w) OVER (PARTITION BY ts ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS tail FROM ordered), tested AS (SELECT *, w * (1.0 - (k - 1) * 0.3) / tail < 0.3 AS under FROM tails), cut AS (
  SELECT *, min(CASE WHEN under THEN k END) OVER (PARTITION BY ts) AS first_free FROM tested), free AS (SELECT *, sum(CASE WHEN k >= first_free THEN w END) OVER (PARTITION BY ts) AS free_sum FROM cut)
SELECT {out('capped')} FROM (SELECT *, CASE WHEN first_free IS NULL OR k < first_free THEN 0.3 ELSE w * (1.0 - (first_free - 1) * 0.3) / free_sum END AS capped FROM free)""")
def j05_position_caps(spark, sf_dir):
    weighed = strategy.policy_weights(strategy.top_n(panel(spark, sf_dir), 5)).where("inverse_volatility is not null")
    return rounded(strategy.capped(weighed, "inverse_volatility", cap=0.3, budget=1.0), "capped")


@query(f"""{_WEIGHTS}, moves AS (SELECT *, score_weight AS target, coalesce(lag(score_weight) OVER ({P}), 0.0) AS current FROM weighed), changed AS (
  SELECT *, CASE WHEN abs(target - current) < 0.02 THEN 0 ELSE target - current END AS change FROM moves), budget AS (SELECT *, sum(abs(change)) OVER (PARTITION BY ts) AS turnover FROM changed)
SELECT {out('current', 'executed')} FROM (SELECT *, current + change * CASE WHEN turnover > 0.4 THEN 0.4 / turnover ELSE 1 END AS executed FROM budget)""")
def j08_turnover_budget(spark, sf_dir):
    weighed = strategy.policy_weights(strategy.top_n(panel(spark, sf_dir), 5)).withColumn("target", F.col("score_weight"))
    weighed = weighed.withColumn("current", F.coalesce(F.lag("target").over(by_time()), F.lit(0.0)))
    return rounded(strategy.limit_turnover(weighed, budget=0.4, least=0.02), "current", "executed")


@query(f"WITH RECURSIVE {H}, {NUMBERED_SQL}, {_CHANGES}, {wilder_sql('up', 'changes', 'gain', 15, 14)}, {wilder_sql('down', 'changes', 'loss', 15, 14)}, a AS (SELECT n.symbol, n.ts, CASE WHEN up + down = 0 THEN 0 ELSE 100 * up / (up + down) END AS rsi, CASE WHEN n.rn >= 5 THEN avg(close) OVER (PARTITION BY n.symbol ORDER BY n.ts ROWS 4 PRECEDING) END AS fast, CASE WHEN n.rn >= 15 THEN avg(close) OVER (PARTITION BY n.symbol ORDER BY n.ts ROWS 14 PRECEDING) END AS slow FROM numbered n LEFT JOIN up USING (symbol, rn) LEFT JOIN down USING (symbol, rn)), b AS (SELECT *, lag(fast) OVER ({P}) AS f, lag(slow) OVER ({P}) AS s FROM a), c AS (SELECT symbol, ts, coalesce(fast > slow AND f <= s AND rsi < 60, false) AS entry, coalesce(fast < slow AND f >= s, false) OR coalesce(rsi > 70, false) AS exit FROM b) SELECT symbol, epoch(ts)::BIGINT AS t, entry, exit FROM c WHERE entry OR exit")
def j20_entry_exit_signals(spark, sf_dir):
    from barspark.operators import research

    df = ind.rsi(bars(spark, sf_dir)).withColumns({"fast": ind.sma("close", 5), "slow": ind.sma("close", 15)})
    return research.entry_exit_signals(df, 60.0, 70.0).where("entry or exit").select("symbol", F.unix_seconds("ts").alias("t"), "entry", "exit")


@query(f"""WITH {H}, {NUMBERED_SQL}, entries AS (SELECT symbol, ts, rn, lead(open) OVER ({P}) AS entry, CASE WHEN close < open THEN 'short' ELSE 'long' END AS direction FROM numbered), e AS (
  SELECT *, CASE WHEN direction = 'short' THEN entry / 0.4 ELSE entry * 1.5 END AS upper, CASE WHEN direction = 'short' THEN entry / 1.5 ELSE entry * 0.4 END AS lower FROM entries WHERE entry IS NOT NULL), hits AS (
  SELECT e.symbol, e.rn, e.ts, entry, direction, upper, lower, min(b.rn) AS hit FROM e LEFT JOIN numbered b ON b.symbol = e.symbol AND b.rn > e.rn AND (b.high > upper OR b.low < lower) GROUP BY ALL)
SELECT h.symbol, epoch(h.ts)::BIGINT AS t, direction, round(entry, 6) AS entry, coalesce(hit, -1) AS hit, CASE WHEN hit IS NULL THEN 'open' WHEN b.high > upper AND b.low < lower THEN 'inconclusive' WHEN (b.high > upper) = (direction = 'long') THEN 'win' ELSE 'loss' END AS outcome
FROM hits h LEFT JOIN numbered b ON b.symbol = h.symbol AND b.rn = h.hit""")
def j14_bracket_outcomes(spark, sf_dir):
    side = F.when(F.col("close") < F.col("open"), "short").otherwise("long")
    found = strategy.bracket_outcomes(bars(spark, sf_dir), F.lit(True), win=1.5, stop=0.4, direction=side)
    return found.select("symbol", F.unix_seconds("ts").alias("t"), "direction", F.round("entry", 6).alias("entry"), F.coalesce("hit", F.lit(-1)).alias("hit"), "outcome")


@query(f"""WITH {H}, {NUMBERED_SQL}, m AS (SELECT *, CASE WHEN rn >= 5 THEN avg(close) OVER ({P} ROWS 4 PRECEDING) END AS f, CASE WHEN rn >= 15 THEN avg(close) OVER ({P} ROWS 14 PRECEDING) END AS s FROM numbered), x AS (SELECT *, lag(f) OVER ({P}) AS f0, lag(s) OVER ({P}) AS s0, lead(open) OVER ({P}) AS entry FROM m), entries AS (SELECT symbol, ts, rn, entry, CASE WHEN f > s THEN 'long' ELSE 'short' END AS direction FROM x WHERE (f > s AND f0 <= s0) OR (f < s AND f0 >= s0)), e AS (
  SELECT *, CASE WHEN direction = 'short' THEN entry / 0.4 ELSE entry * 1.5 END AS upper, CASE WHEN direction = 'short' THEN entry / 1.5 ELSE entry * 0.4 END AS lower FROM entries WHERE entry IS NOT NULL), hits AS (
  SELECT e.symbol, e.rn, e.ts, entry, direction, upper, lower, min(b.rn) AS hit FROM e LEFT JOIN numbered b ON b.symbol = e.symbol AND b.rn > e.rn AND (b.high > upper OR b.low < lower) GROUP BY ALL)
SELECT h.symbol, epoch(h.ts)::BIGINT AS t, direction, round(entry, 6) AS entry, coalesce(hit, -1) AS hit, CASE WHEN hit IS NULL THEN 'open' WHEN b.high > upper AND b.low < lower THEN 'inconclusive' WHEN (b.high > upper) = (direction = 'long') THEN 'win' ELSE 'loss' END AS outcome
FROM hits h LEFT JOIN numbered b ON b.symbol = h.symbol AND b.rn = h.hit""")
def u07_bracket_by_name(spark, sf_dir):
    """A bracket strategy from its specification to outcomes."""
    spec = {"name": "average_crossing", "config": {"fast": 5, "slow": 15, "win": 1.5, "stop": 0.4, "shorts": True}}
    found = strategies.outcomes_of(bars(spark, sf_dir), spec)
    return found.select("symbol", F.unix_seconds("ts").alias("t"), "direction", F.round("entry", 6).alias("entry"), F.coalesce("hit", F.lit(-1)).alias("hit"), "outcome")


@query(f"WITH {H}, {NUMBERED_SQL}, x AS (SELECT *, avg(close) OVER ({P} ROWS 19 PRECEDING) AS sma FROM numbered) SELECT symbol, epoch(ts)::BIGINT AS t, round(sma, 6) AS sma, round(close / sma - 1, 6) AS over_sma FROM x WHERE rn > 20")
def e11_described_indicators(spark, sf_dir):
    """Rows behind the longest warm-up that the columns tell of: 19 of the average, 20 of the index."""
    recipe = registry.load('[{"name": "indicator", "config": {"indicator": "sma"}}, {"name": "indicator", "config": {"indicator": "rsi", "period": 20}}]')
    out, _ = recipe.run(event_bars(spark, sf_dir), Contract("1h"), backtest=True)
    return described.warmed(out).select("symbol", F.unix_seconds("ts").alias("t"), F.round("sma", 6).alias("sma"), F.round(F.col("close") / F.col("sma") - 1, 6).alias("over_sma"))


_BANDS = "SELECT symbol, ts, 'session' AS mode, first(open) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) AS reference FROM numbered UNION ALL SELECT symbol, ts, 'first', first(open) OVER (PARTITION BY symbol ORDER BY ts) FROM numbered UNION ALL SELECT symbol, ts, 'bar', open FROM numbered"


@query(f"WITH {H}, {NUMBERED_SQL}, b AS ({_BANDS}) SELECT mode, {out('reference', 'upper', 'lower')} FROM (SELECT *, reference * 1.01 AS upper, reference * 0.99 AS lower FROM b)")
def e29_open_bands(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    found = strategy.open_bands(bars, 1.0, F.to_date("ts")).withColumn("mode", F.lit("session"))
    for mode in ("first", "bar"):
        found = found.union(strategy.open_bands(bars, 1.0, mode=mode).withColumn("mode", F.lit(mode)))
    return found.select("mode", "symbol", F.unix_seconds("ts").alias("t"), *[F.round(c, 6).alias(c) for c in ("reference", "upper", "lower")])
