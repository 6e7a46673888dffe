"""Momentum reports: daily, weekly and monthly scores with their alignment, and the intraday report with its levels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import bars as bar_ops
from ..operators import levels as level_ops
from ..operators import windows as win
from ..sources.tables import BARS, HOURS, bars_daily, bars_hourly, saved
from .registry import query
from .windows import all_rounded

#: The weights of each frame's components, and the bars their deviation is taken from.
WEIGHTS = {
    "daily": {"rsi": 0.15, "hist": 0.15, "hist_slope_3": 0.10, "roc_10": 0.15, "ema_20": 0.10, "ema_50": 0.10, "ema_20_slope_5": 0.10, "adx": 0.10, "pct_b": 0.05},
    "weekly": {"rsi": 0.20, "hist": 0.20, "roc_13": 0.20, "sma_10": 0.15, "sma_40": 0.15, "adx": 0.10},
    "monthly": {"return_12_1": 0.30, "roc_3": 0.15, "roc_6": 0.15, "sma_10": 0.15, "hist": 0.15, "rsi": 0.10},
}
WINDOWS = {"daily": 252, "weekly": 156, "monthly": 120}
#: The weights of the intraday report.
INTRADAY = {"velocity": 0.25, "drift": 0.20, "acceleration": 0.20, "rsi": 0.10, "macd": 0.10, "volume": 0.15}


def frames(bars: DataFrame) -> DataFrame:
    """(frame, symbol, day, high, low, close): daily bars, and weekly and monthly ones that ended before the symbol's last day."""
    last = bars.groupBy("symbol").agg(F.max("day").alias("last"))
    parts = [bars.select(F.lit("daily").alias("frame"), "symbol", "day", "high", "low", "close")]
    for name, label in (("weekly", bar_ops.week_ending_friday(F.col("day"))), ("monthly", F.last_day("day"))):
        r = bar_ops.resample(bars, label).join(last, "symbol").where("label < last")
        parts.append(r.select(F.lit(name).alias("frame"), "symbol", F.col("label").alias("day"), "high", "low", "close"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def components(bars: DataFrame) -> DataFrame:
    """(frame, symbol, day, name, value, weight) of every bar and component of its frame; unknown values are left out."""
    f = frames(bars)
    i = f.groupBy("frame", "symbol").applyInPandas(kernels.indicators, f"frame string, symbol string, day date, high double, low double, close double, {kernels.INDICATORS}")
    w = Window.partitionBy("frame", "symbol").orderBy("day")
    c, back = F.col("close"), lambda x, k: F.lag(x, k).over(w)

    def mean(n: int) -> Column:
        return F.when(F.count("*").over(w.rowsBetween(1 - n, 0)) == n, F.avg("close").over(w.rowsBetween(1 - n, 0)))

    i = i.withColumns({"h": F.col("histogram") / c, "m20": mean(20), "s20": F.stddev_pop("close").over(w.rowsBetween(-19, 0)), "m10": mean(10), "m40": mean(40)})
    values = {
        "rsi": F.col("rsi_ewm") - 50,
        "hist": F.col("h"),
        "hist_slope_3": F.col("h") - back("h", 3),
        "ema_20": c / F.col("ema_20") - 1,
        "ema_50": c / F.col("ema_50") - 1,
        "ema_20_slope_5": F.col("ema_20") / back("ema_20", 5) - 1,
        "adx": F.col("adx") / 100 * F.signum(F.col("plus_di") - F.col("minus_di")),
        "pct_b": F.when(F.col("s20") > 0, (c - F.col("m20") + 2 * F.col("s20")) / (4 * F.col("s20")) - 0.5),
        "sma_10": c / F.col("m10") - 1,
        "sma_40": c / F.col("m40") - 1,
        "return_12_1": back("close", 1) / back("close", 12) - 1,
    } | {f"roc_{n}": c / back("close", n) - 1 for n in (3, 6, 10, 13)}
    named = i.select("frame", "symbol", "day", *(v.alias(f"v_{k}") for k, v in values.items()))
    each = F.lit(None).cast("array<struct<name:string,value:double,weight:double>>")
    for frame, weights in WEIGHTS.items():
        own = F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"v_{k}").alias("value"), F.lit(x).alias("weight")) for k, x in weights.items()))
        each = F.when(F.col("frame") == frame, own).otherwise(each)
    return named.select("frame", "symbol", "day", F.explode(each).alias("c")).select("frame", "symbol", "day", "c.*").where("value IS NOT NULL AND NOT isnan(value)")


def component_scores(bars: DataFrame) -> DataFrame:
    """(frame, symbol, name, value, score, weight): each last value over twice the deviation of its frame's window, clipped to 1; no score with fewer than 20 values."""
    size = F.create_map(*(F.lit(x) for kv in WINDOWS.items() for x in kv))[F.col("frame")]
    rank = F.row_number().over(Window.partitionBy("frame", "symbol", "name").orderBy(F.desc("day")))
    g = components(bars).withColumn("r", rank).groupBy("frame", "symbol", "name").agg(
        F.max_by("value", "day").alias("value"), F.first("weight").alias("weight"), F.count("*").alias("n"), F.stddev_pop(F.when(F.col("r") <= size, F.col("value"))).alias("sd")
    )
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("value") / (2 * F.col("sd"))))
    score = F.when(F.col("n") >= 20, F.when(F.col("sd") < 1e-12, 0.0).otherwise(clipped))
    return g.select("frame", "symbol", "name", F.when(F.col("n") >= 20, F.col("value")).alias("value"), score.alias("score"), "weight")


def frame_scores(scores: DataFrame) -> DataFrame:
    """(symbol, frame, score, label, known): the weighted mean of a frame's known scores, in percent."""
    s = scores.groupBy("symbol", "frame").agg((100 * F.sum(F.col("score") * F.col("weight")) / F.sum(F.when(F.col("score").isNotNull(), F.col("weight")))).alias("score"), F.count("score").alias("known"))
    x = F.col("score")
    label = F.when(x.isNull(), "unknown").when(x > 60, "strong up").when(x > 20, "up").when(x >= -20, "neutral").when(x > -60, "down").otherwise("strong down")
    return s.select("symbol", "frame", "score", label.alias("label"), "known")


def aligned(scores: DataFrame) -> DataFrame:
    """(symbol, daily, weekly, monthly, state): the signs beyond 20 of the frames' scores, as reported with one decimal, and whether they agree."""
    shown = F.round("score", 1)
    sign = F.when(shown > 20, 1).when(shown < -20, -1).otherwise(0)
    s = scores.groupBy("symbol").agg(*(F.coalesce(F.max(F.when(F.col("frame") == f, sign)), F.lit(0)).alias(f) for f in WEIGHTS))
    d, w, m = F.col("daily"), F.col("weekly"), F.col("monthly")
    state = F.when((d == 1) & (w == 1) & (m == 1), "aligned up").when((d == -1) & (w == -1) & (m == -1), "aligned down").when((m == 1) & (d == -1), "correction in an uptrend").when((m == -1) & (d == 1), "reaction in a downtrend")
    return s.withColumn("state", state.otherwise("mixed"))


_FRAMES = """last_day_ AS (SELECT symbol, max(day) AS last FROM bars GROUP BY symbol),
lab AS (SELECT 'daily' AS frame, symbol, day AS label, day, high, low, close FROM bars UNION ALL SELECT 'weekly', symbol, CAST(day + CAST((5 - isodow(day) + 7) % 7 AS INTEGER) AS DATE), day, high, low, close FROM bars
  UNION ALL SELECT 'monthly', symbol, last_day(day), day, high, low, close FROM bars),
fb AS (SELECT frame, lab.symbol, label AS day, max(high) AS high, min(low) AS low, arg_max(close, lab.day) AS close FROM lab JOIN last_day_ l ON l.symbol = lab.symbol WHERE frame = 'daily' OR label < last GROUP BY frame, lab.symbol, label),
fn AS (SELECT *, row_number() OVER w AS i, close - lag(close) OVER w AS d, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, high - lag(high) OVER w AS u, lag(low) OVER w - low AS v FROM fb WINDOW w AS (PARTITION BY frame, symbol ORDER BY day)),
fi AS (SELECT frame, symbol, i, day, close, close AS a, close AS b, close AS e20, close AS e50, 0::DOUBLE AS s, NULL::DOUBLE AS g, NULL::DOUBLE AS l, 0::DOUBLE AS p, 0::DOUBLE AS q, NULL::DOUBLE AS x FROM fn WHERE i = 1 UNION ALL
  SELECT frame, symbol, i, day, close, a, b, e20, e50, s + 0.2::DOUBLE * (a - b - s), g, l, p, q, CASE WHEN p + q > 0 THEN coalesce(x + (100 * abs(p - q) / (p + q) - x) / 14, 100 * abs(p - q) / (p + q)) ELSE x END FROM (
    SELECT fn.frame, fn.symbol, fn.i, fn.day, fn.close, a + 2.0::DOUBLE / 13 * (fn.close - a) AS a, b + 2.0::DOUBLE / 27 * (fn.close - b) AS b, e20 + 2.0::DOUBLE / 21 * (fn.close - e20) AS e20, e50 + 2.0::DOUBLE / 51 * (fn.close - e50) AS e50, s,
      coalesce(g + (greatest(d, 0) - g) / 14, greatest(d, 0)) AS g, coalesce(l + (greatest(-d, 0) - l) / 14, greatest(-d, 0)) AS l,
      p + (CASE WHEN u > v AND u > 0 THEN u ELSE 0 END - p) / 14 AS p, q + (CASE WHEN v > u AND v > 0 THEN v ELSE 0 END - q) / 14 AS q, x FROM fi JOIN fn ON fn.frame = fi.frame AND fn.symbol = fi.symbol AND fn.i = fi.i + 1)),
fh AS (SELECT *, (a - b - s) / close AS h, CASE WHEN i > 14 THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) ELSE 100 END END AS rsi, CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 END AS m20, stddev_pop(close) OVER w20 AS s20,
    CASE WHEN count(*) OVER w10 = 10 THEN avg(close) OVER w10 END AS m10, CASE WHEN count(*) OVER w40 = 40 THEN avg(close) OVER w40 END AS m40 FROM fi
  WINDOW w20 AS (PARTITION BY frame, symbol ORDER BY day ROWS 19 PRECEDING), w10 AS (PARTITION BY frame, symbol ORDER BY day ROWS 9 PRECEDING), w40 AS (PARTITION BY frame, symbol ORDER BY day ROWS 39 PRECEDING)),
fv AS (SELECT frame, symbol, day, rsi - 50 AS rsi, h AS hist, h - lag(h, 3) OVER w AS hist_slope_3, close / e20 - 1 AS ema_20, close / e50 - 1 AS ema_50, e20 / lag(e20, 5) OVER w - 1 AS ema_20_slope_5, x / 100 * sign(p - q) AS adx,
    CASE WHEN s20 > 0 THEN (close - m20 + 2 * s20) / (4 * s20) - 0.5 END AS pct_b, close / m10 - 1 AS sma_10, close / m40 - 1 AS sma_40, lag(close, 1) OVER w / lag(close, 12) OVER w - 1 AS return_12_1,
    close / lag(close, 3) OVER w - 1 AS roc_3, close / lag(close, 6) OVER w - 1 AS roc_6, close / lag(close, 10) OVER w - 1 AS roc_10, close / lag(close, 13) OVER w - 1 AS roc_13 FROM fh WINDOW w AS (PARTITION BY frame, symbol ORDER BY day))"""
_NAMES = ", ".join(sorted({k for w in WEIGHTS.values() for k in w}))
_TABLE = ", ".join(f"('{f}', {WINDOWS[f]}, '{k}', {x}::DOUBLE)" for f, w in WEIGHTS.items() for k, x in w.items())
_SCORES = f"""{_FRAMES}, wt AS (SELECT * FROM (VALUES {_TABLE}) t(frame, size, name, weight)),
fl AS (UNPIVOT fv ON {_NAMES} INTO NAME name VALUE value),
fr AS (SELECT fl.frame, symbol, fl.name, day, value, weight, size, row_number() OVER (PARTITION BY fl.frame, symbol, fl.name ORDER BY day DESC) AS r FROM fl JOIN wt ON wt.frame = fl.frame AND wt.name = fl.name),
sc AS (SELECT frame, symbol, name, any_value(weight) AS weight, count(*) AS n, arg_max(value, day) AS value, stddev_pop(value) FILTER (WHERE r <= size) AS sd FROM fr GROUP BY frame, symbol, name),
cs AS (SELECT frame, symbol, name, CASE WHEN n >= 20 THEN value END AS value, CASE WHEN n >= 20 THEN CASE WHEN sd < 1e-12 THEN 0 ELSE least(1, greatest(-1, value / (2 * sd))) END END AS score, weight FROM sc),
fs AS (SELECT symbol, frame, 100 * sum(score * weight) / sum(weight) FILTER (WHERE score IS NOT NULL) AS score, count(score) AS known FROM cs GROUP BY symbol, frame)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_scores(saved(bars_daily(spark, sf_dir)))


@query(f"WITH RECURSIVE {BARS}, {_SCORES} SELECT frame, symbol, name, round(value, 4) AS value, round(score, 4) AS score, weight FROM cs")
def momentum_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(_scores(spark, sf_dir), 4)


@query(
    f"""WITH RECURSIVE {BARS}, {_SCORES} SELECT symbol, frame, round(score, 4) AS score, CASE WHEN score IS NULL THEN 'unknown' WHEN score > 60 THEN 'strong up' WHEN score > 20 THEN 'up' WHEN score >= -20 THEN 'neutral' WHEN score > -60 THEN 'down' ELSE 'strong down' END AS label, known FROM fs"""
)
def momentum_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(frame_scores(_scores(spark, sf_dir)), 4)


@query(
    f"""WITH RECURSIVE {BARS}, {_SCORES}, sg AS (SELECT symbol, frame, CASE WHEN round(score, 1) > 20 THEN 1 WHEN round(score, 1) < -20 THEN -1 ELSE 0 END AS s FROM fs),
al AS (SELECT symbol, coalesce(max(s) FILTER (WHERE frame = 'daily'), 0) AS daily, coalesce(max(s) FILTER (WHERE frame = 'weekly'), 0) AS weekly, coalesce(max(s) FILTER (WHERE frame = 'monthly'), 0) AS monthly FROM sg GROUP BY symbol)
SELECT *, CASE WHEN daily + weekly + monthly = 3 THEN 'aligned up' WHEN daily + weekly + monthly = -3 THEN 'aligned down' WHEN monthly = 1 AND daily = -1 THEN 'correction in an uptrend' WHEN monthly = -1 AND daily = 1 THEN 'reaction in a downtrend' ELSE 'mixed' END AS state FROM al"""
)
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(frame_scores(_scores(spark, sf_dir)))


_REPORT = ", ".join(f"{k} double" for k in INTRADAY) + ", t double, strength int, direction string, trend string, price double, sigma double, session_bars int, remaining int, expected_move double"


def intraday(hours: DataFrame) -> DataFrame:
    """The intraday report of every symbol of (symbol, ts, c, v) that has enough bars."""

    def report(b: pd.DataFrame) -> pd.DataFrame:
        r = kernels.last_report(b, INTRADAY)
        names = ["symbol", *(c.split()[0] for c in _REPORT.split(", "))]
        return pd.DataFrame([{"symbol": b["symbol"].iloc[0]} | r] if r else [], columns=names)

    return hours.select("symbol", "ts", "c", "v").groupBy("symbol").applyInPandas(report, f"symbol string, {_REPORT}")


_INTRADAY = f"""hn AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n, CAST(max(ts) OVER (PARTITION BY symbol) AS DATE) AS today, c - lag(c) OVER w AS d FROM hours WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
ses AS (SELECT symbol, any_value(n) AS n, any_value(today) AS today, count(*) FILTER (WHERE day = today) AS ns FROM hn GROUP BY symbol),
bs AS (SELECT hn.*, ns, row_number() OVER (PARTITION BY hn.symbol ORDER BY ts) AS k, ln(c / lag(c) OVER (PARTITION BY hn.symbol ORDER BY ts)) AS r FROM hn JOIN ses ON ses.symbol = hn.symbol WHERE ns < 24 OR day = hn.today),
sg AS (SELECT symbol, stddev_samp(r) AS sigma, count(*) AS nb, arg_min(c, ts) AS c0, arg_max(c, ts) AS c1, list(v ORDER BY ts) FILTER (WHERE v > 0) AS vs FROM bs GROUP BY symbol),
sd AS (SELECT symbol, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM hn WHERE i BETWEEN 2 AND 15 GROUP BY symbol),
rc AS (SELECT hn.symbol, i, c AS a, c AS b, 0::DOUBLE AS s, sd.g, sd.l FROM hn JOIN sd ON sd.symbol = hn.symbol WHERE i = 1 UNION ALL
  SELECT symbol, i, a, b, s + 0.2::DOUBLE * (a - b - s), g, l FROM (SELECT hn.symbol, hn.i, a + 2.0::DOUBLE / 13 * (c - a) AS a, b + 2.0::DOUBLE / 27 * (c - b) AS b, s,
    CASE WHEN hn.i > 15 THEN (rc.g * 13 + greatest(d, 0)) / 14 ELSE rc.g END AS g, CASE WHEN hn.i > 15 THEN (rc.l * 13 + greatest(-d, 0)) / 14 ELSE rc.l END AS l FROM rc JOIN hn ON hn.symbol = rc.symbol AND hn.i = rc.i + 1)),
lastc AS (SELECT hn.symbol, max(c) FILTER (WHERE i = n) AS c, max(c) FILTER (WHERE i = n - 12) AS c12, max(c) FILTER (WHERE i = n - 24) AS c24 FROM hn GROUP BY hn.symbol),
lens AS (SELECT symbol, max(k) AS longest FROM (SELECT symbol, day, count(*) AS k FROM hn WHERE day <> today GROUP BY symbol, day) GROUP BY symbol),
pa AS (SELECT ses.symbol, c AS price, sigma, ns, coalesce(longest, ns) AS expected, ln(c / c12) / (sigma * sqrt(12) + 1e-12) AS velocity, CASE WHEN n > 24 THEN ln(c12 / c24) / (sigma * sqrt(12) + 1e-12) ELSE 0 END AS before,
    (CASE WHEN l > 1e-12 THEN 100 - 100 / (1 + g / l) WHEN g > 1e-12 THEN 100 ELSE 50 END - 50) / 25 AS rsi, (a - b - s) / (c * sigma + 1e-12) AS macd, CASE WHEN nb > 12 THEN ln(c1 / c0) / (sigma * sqrt(nb - 1)) END AS drift,
    CASE WHEN len(vs) >= 24 THEN abs(ln(list_avg(vs[-12:]) / list_sort(vs)[len(vs) // 2 + 1])) END AS vol
  FROM ses JOIN sg USING (symbol) JOIN lastc USING (symbol) JOIN rc ON rc.symbol = ses.symbol AND rc.i = ses.n LEFT JOIN lens ON lens.symbol = ses.symbol WHERE n >= 47 AND sigma > 1e-12),
pb AS (SELECT *, velocity - before AS acceleration, CASE WHEN velocity < 0 THEN -vol ELSE vol END AS volume FROM pa),
pw AS (SELECT *, list_filter([{{x: velocity, w: 0.25::DOUBLE}}, {{x: drift, w: 0.2::DOUBLE}}, {{x: acceleration, w: 0.2::DOUBLE}}, {{x: rsi, w: 0.1::DOUBLE}}, {{x: macd, w: 0.1::DOUBLE}}, {{x: volume, w: 0.15::DOUBLE}}], lambda p: p.x IS NOT NULL) AS ps FROM pb),
pm AS (SELECT *, list_sum(list_transform(ps, lambda p: p.x * p.w)) / list_sum(list_transform(ps, lambda p: p.w)) AS mean FROM pw),
pd AS (SELECT *, sqrt(list_sum(list_transform(ps, lambda p: p.w * (p.x - mean) ** 2)) / list_sum(list_transform(ps, lambda p: p.w))) AS spread FROM pm),
pt AS (SELECT *, mean / (spread / sqrt(len(ps)) + 1e-12) AS t, greatest(1, expected - ns) AS remaining FROM pd),
rep AS (SELECT symbol, velocity, drift, acceleration, rsi, macd, volume, t, CAST(round(100 * (2 / (1 + exp(-least(40, abs(mean) * (0.5 + abs(mean) / (abs(mean) + spread + 1e-12))))) - 1)) AS INTEGER) AS strength,
  CASE WHEN abs(t) < 1 OR greatest(abs(velocity), coalesce(abs(drift), 0)) < 1 THEN 'neutral' WHEN mean > 0 THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN abs(abs(velocity) - abs(before)) < 1 / sqrt(12) THEN 'stable' WHEN abs(velocity) > abs(before) THEN 'stronger' ELSE 'weaker' END AS trend, price, sigma, CAST(ns AS INTEGER) AS session_bars, CAST(remaining AS INTEGER) AS remaining,
  price * sigma * sqrt(remaining) * (1 + abs(t) / (1 + abs(t))) AS expected_move FROM pt)"""


@query(
    f"WITH RECURSIVE {HOURS}, {_INTRADAY} SELECT symbol, "
    + ", ".join(f"round({c}, 4) AS {c}" for c in [*INTRADAY, "t"])
    + ", strength, direction, trend, round(price, 4) AS price, round(sigma, 4) AS sigma, session_bars, remaining, round(expected_move, 4) AS expected_move FROM rep"
)
def intraday_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(intraday(bars_hourly(spark, sf_dir)), 4)


def level_candidates(daily: DataFrame, today: DataFrame) -> DataFrame:
    """(symbol, price, priority, name) of the last complete day's and week's pivots and the last swings.

    ``today`` has (symbol, today); bars of that day and later are incomplete.
    """
    d = daily.join(today, "symbol").where("day < today")
    classic = F.col("name").isin(*level_ops.CLASSIC)
    day = level_ops.pivots(d.groupBy("symbol").agg(F.max_by(F.struct("high", "low", "close"), "day").alias("p")).select("symbol", "p.*")).where(classic)
    weeks = bar_ops.last_complete(d.select("symbol", "day", "high", "low", "close"), "week", F.col("today"), today)
    week = level_ops.pivots(weeks).where(classic).withColumn("name", F.concat(F.lit("week "), "name"))
    s = win.swings_with_ties(d.select("symbol", "day", "high", "low", "close"), 2, 40)
    stamp = F.date_format("day", "dd.MM")
    ends = F.explode(F.array(F.struct(F.col("is_low").alias("is"), F.concat(stamp, F.lit(" low")).alias("name"), F.col("low").alias("price")), F.struct(F.col("is_high").alias("is"), F.concat(stamp, F.lit(" high")).alias("name"), F.col("high").alias("price"))))
    swing = s.select("symbol", ends.alias("e")).where("e.is").select("symbol", "e.name", "e.price")
    ranked = [x.select("symbol", "price", F.lit(k).alias("priority"), "name") for k, x in enumerate((day, week, swing))]
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2])


def breakout(report: DataFrame, levels: DataFrame) -> DataFrame:
    """What a symbol's momentum may break: nearest levels beyond the noise margin, those being touched, and the score of the target.

    ``levels`` has (symbol, name, price) of clusters. Upward momentum aims at the
    resistance, downward at the support, neutral at the nearer one.
    """
    r = report.withColumn("margin", F.col("price") * F.col("sigma") * 2)
    l = levels.select("symbol", "name", F.col("price").alias("level")).join(r.select("symbol", F.col("price").alias("at"), "margin"), "symbol")
    gap = F.abs(F.col("level") - F.col("at"))
    near = l.groupBy("symbol").agg(
        F.max_by(F.struct("name", "level"), F.when(F.col("level") < F.col("at") - F.col("margin"), F.col("level"))).alias("support"),
        F.min_by(F.struct("name", "level"), F.when(F.col("level") > F.col("at") + F.col("margin"), F.col("level"))).alias("resistance"),
        F.min_by("name", F.when(gap <= F.col("margin"), F.struct(gap, "name"))).alias("touching"),
        F.count("*").alias("levels"),
    )
    j = r.join(near, "symbol", "left")
    below, above = (F.abs(F.col(f"{s}.level") - F.col("price")) for s in ("support", "resistance"))
    has = lambda s: F.col(f"{s}.level").isNotNull()
    side = F.when((F.col("direction") == "up") & has("resistance"), "resistance").when((F.col("direction") == "down") & has("support"), "support")
    side = side.when((F.col("direction") == "neutral") & has("support") & has("resistance"), F.when(below <= above, "support").otherwise("resistance"))
    j = j.withColumn("side", side)
    distance = F.when(F.col("side") == "support", below).when(F.col("side") == "resistance", above)
    j = j.withColumn("reach", F.col("expected_move") / (distance + 1e-12))
    score = level_ops.break_score(F.col("reach"), F.col("strength"))
    outside = F.when(F.col("levels").isNull(), None).when(~has("resistance"), "above").when(~has("support"), "below")
    return j.select(
        "symbol", F.col("support.name").alias("support"), F.col("resistance.name").alias("resistance"), "touching", outside.alias("outside"), "side", distance.alias("distance"), (distance / (F.col("price") * F.col("sigma") + 1e-12)).alias("distance_sigma"), F.when(F.col("reach").isNotNull(), F.least("reach", F.lit(99.0))).alias("reach"), score.alias("score"), level_ops.break_label(score).alias("strength")
    )


_BREAKOUT = f"""{_INTRADAY}, hd AS (SELECT symbol, CAST(ts AS DATE) AS day, max(h) AS high, min(l) AS low, arg_max(c, ts) AS close FROM hours GROUP BY 1, 2),
hc AS (SELECT hd.* , today FROM hd JOIN ses USING (symbol) WHERE day < today),
hp AS (SELECT symbol, 0 AS priority, '' AS prefix, arg_max(high, day) AS high, arg_max(low, day) AS low, arg_max(close, day) AS close FROM hc GROUP BY symbol UNION ALL
  SELECT symbol, 1, 'week ', high, low, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) AS k FROM (SELECT symbol, CAST(date_trunc('week', day) AS DATE) AS bucket, any_value(today) AS today, max(high) AS high, min(low) AS low, arg_max(close, day) AS close FROM hc GROUP BY 1, 2) WHERE bucket + 5 <= today) WHERE k = 1),
h40 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM hc) WHERE k <= 40),
hs AS (SELECT *, count(*) OVER w = 5 AND low = min(low) OVER w AS is_low, count(*) OVER w = 5 AND high = max(high) OVER w AS is_high FROM h40 WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
lv AS (SELECT symbol, priority, prefix || unnest(['p', 'r1', 's1', 'r2', 's2', 'r3', 's3']) AS name, unnest([p, 2 * p - low, 2 * p - high, p + high - low, p - (high - low), high + 2 * (p - low), low - 2 * (high - p)]) AS price FROM (SELECT *, (high + low + close) / 3 AS p FROM hp)
  UNION ALL SELECT symbol, 2, strftime(day, '%d.%m') || ' low', low FROM hs WHERE is_low UNION ALL SELECT symbol, 2, strftime(day, '%d.%m') || ' high', high FROM hs WHERE is_high),
lt AS (SELECT lv.*, CASE WHEN lv.price - lag(lv.price) OVER w > rep.price * sigma * 2 THEN 1 ELSE 0 END AS new FROM lv JOIN rep USING (symbol) WINDOW w AS (PARTITION BY lv.symbol ORDER BY lv.price, priority, name)),
lc AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY price, priority, name) AS cluster FROM lt),
cl AS (SELECT symbol, avg(price) AS level, arg_min(name, (priority, name)) AS name FROM lc GROUP BY symbol, cluster),
nr AS (SELECT rep.symbol, max(level) FILTER (WHERE level < price - price * sigma * 2) AS sl, arg_max(name, level) FILTER (WHERE level < price - price * sigma * 2) AS support, min(level) FILTER (WHERE level > price + price * sigma * 2) AS rl, arg_min(name, level) FILTER (WHERE level > price + price * sigma * 2) AS resistance,
  arg_min(name, (abs(level - price), name)) FILTER (WHERE abs(level - price) <= price * sigma * 2) AS touching, count(*) AS levels FROM rep JOIN cl USING (symbol) GROUP BY rep.symbol),
tg AS (SELECT rep.*, sl, rl, support, resistance, touching, levels, CASE WHEN direction = 'up' AND rl IS NOT NULL THEN 'resistance' WHEN direction = 'down' AND sl IS NOT NULL THEN 'support' WHEN direction = 'neutral' AND sl IS NOT NULL AND rl IS NOT NULL THEN CASE WHEN abs(sl - price) <= abs(rl - price) THEN 'support' ELSE 'resistance' END END AS side FROM rep LEFT JOIN nr USING (symbol)),
ds AS (SELECT *, CASE side WHEN 'support' THEN abs(sl - price) WHEN 'resistance' THEN abs(rl - price) END AS distance FROM tg),
bk AS (SELECT *, CASE WHEN distance IS NOT NULL THEN sqrt(least(1, expected_move / (distance + 1e-12)) * strength / 100) END AS score FROM ds)
SELECT symbol, support, resistance, touching, CASE WHEN levels IS NULL THEN NULL WHEN rl IS NULL THEN 'above' WHEN sl IS NULL THEN 'below' END AS outside, side, round(distance, 4) AS distance, round(distance / (price * sigma + 1e-12), 4) AS distance_sigma,
  CASE WHEN distance IS NOT NULL THEN round(least(99, expected_move / (distance + 1e-12)), 4) END AS reach, round(score, 4) AS score, CASE WHEN score >= 2.0 / 3 THEN 'strong' WHEN score >= 1.0 / 3 THEN 'medium' WHEN score IS NOT NULL THEN 'weak' END AS strength FROM bk"""


@query(f"WITH RECURSIVE {HOURS}, {_BREAKOUT}")
def intraday_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = saved(bars_hourly(spark, sf_dir))
    day = F.to_date("ts")
    daily = hours.groupBy("symbol", day.alias("day")).agg(F.max("h").alias("high"), F.min("l").alias("low"), F.max_by("c", "ts").alias("close"))
    report = saved(intraday(hours))
    candidates = level_candidates(daily, hours.groupBy("symbol").agg(F.max(day).alias("today")))
    tolerance = report.select("symbol", (F.col("price") * F.col("sigma") * 2).alias("tolerance"))
    clusters = level_ops.cluster(candidates.join(tolerance, "symbol"), F.col("tolerance"))
    return all_rounded(breakout(report, clusters), 4)
