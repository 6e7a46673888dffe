"""Queries over row windows of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as ops
from ..sources.tables import BARS, bars_daily
from .bars import rounded
from .registry import query

_W = "WINDOW w AS (PARTITION BY symbol ORDER BY day)"


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def all_rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(df, *[c for c, t in df.dtypes if t == "double"], digits=digits)


_D = f"""d AS (SELECT *, ln(close / lag(close) OVER w) AS r, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
  close - lag(close) OVER w AS d, row_number() OVER w AS n FROM bars {_W})"""


@query(
    f"""WITH {BARS}, {_D}, g AS (SELECT *, avg(greatest(d, 0)) OVER {frame(14)} AS up, avg(greatest(-d, 0)) OVER {frame(14)} AS down FROM d),
f AS (SELECT symbol, day, n, close, {", ".join(f"close / lag(close, {k}) OVER w - 1 AS return_{k}" for k in (1, 5, 20))}, close / avg(close) OVER {frame(50)} - 1 AS ma50_distance,
  (100 - 100 / (1 + up / CASE WHEN down = 0 THEN 1e-9 ELSE down END) - 50) / 50 AS rsi14, avg(tr) OVER {frame(14)} / close AS atr14,
  stddev_pop(r) OVER {frame(20)} * sqrt(252) AS volatility_20, close / max(close) OVER {frame(60)} - 1 AS drawdown_60 FROM g {_W})
SELECT symbol, day, round(close, 8) AS close, round(return_1, 6) AS return_1, round(return_5, 6) AS return_5, round(return_20, 6) AS return_20, round(ma50_distance, 6) AS ma50_distance,
  round(rsi14, 6) AS rsi14, round(atr14, 6) AS atr14, round(volatility_20, 6) AS volatility_20, round(drawdown_60, 6) AS drawdown_60 FROM f WHERE n > 60"""
)
def gold_features_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ops.gold_features(bars_daily(spark, sf_dir))
    return rounded(rounded(df, *df.columns[3:], digits=6), "close")


@query(f"WITH {BARS} SELECT symbol, day, " + ", ".join(f"CASE WHEN count(*) OVER {frame(n)} = {n} THEN round(avg(close) OVER {frame(n)}, 6) END AS sma_{n}" for n in (10, 20, 50, 100, 200)) + " FROM bars")
def sma_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.moving_averages(bars_daily(spark, sf_dir)))


@query(
    f"""WITH {BARS}, b AS (SELECT symbol, day, close, CASE WHEN count(*) OVER f = 20 THEN avg(close) OVER f END AS middle, CASE WHEN count(*) OVER f = 20 THEN stddev_pop(close) OVER f END AS sd FROM bars WINDOW f AS {frame(20)})
SELECT symbol, day, round(close, 8) AS close, round(middle, 6) AS middle, round(sd, 6) AS sd, CASE WHEN sd > 0 THEN round((close - (middle - 2 * sd)) / (4 * sd), 6) END AS pct_b FROM b"""
)
def bollinger_pct_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(ops.bollinger(bars_daily(spark, sf_dir)), "middle", "sd", "pct_b", digits=6), "close")


@query(
    f"""WITH {BARS}, b AS (SELECT *, max(high) OVER f14 AS hi, min(low) OVER f14 AS lo, (high + low + close) / 3 AS tp, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM bars WINDOW f14 AS {frame(14)}),
c AS (SELECT *, CASE WHEN hi > lo THEN 100 * (close - lo) / (hi - lo) ELSE 50 END AS k, list(tp) OVER f20 AS tps, avg(tp) OVER f20 AS m FROM b WINDOW f20 AS {frame(20)}),
e AS (SELECT *, list_sum(list_transform(tps, lambda x: abs(x - m))) / len(tps) AS dev, avg(k) OVER {frame(3)} AS dd, lag(close, 10) OVER (PARTITION BY symbol ORDER BY day) AS c10 FROM c)
SELECT symbol, day, round(k, 6) AS stoch_k, round(dd, 6) AS stoch_d, round(CASE WHEN hi > lo THEN -100 * (hi - close) / (hi - lo) ELSE -50 END, 6) AS williams_r,
  round(CASE WHEN dev > 0 THEN (tp - m) / (0.015::DOUBLE * dev) ELSE 0 END, 6) AS cci, round(100 * (close / c10 - 1), 6) AS roc FROM e WHERE n >= 210"""
)
def oscillators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.oscillators(bars_daily(spark, sf_dir)))


def _channel(n: int) -> str:
    return f"""WITH {BARS}, b AS (SELECT symbol, day, ln(close) AS y, CAST(row_number() OVER (PARTITION BY symbol ORDER BY day) AS DOUBLE) AS x FROM bars),
s AS (SELECT *, avg(x) OVER f AS mx, avg(y) OVER f AS my, regr_sxx(y, x) OVER f AS sxx, regr_syy(y, x) OVER f AS syy, regr_sxy(y, x) OVER f AS sxy, count(*) OVER f AS n FROM b WINDOW f AS {frame(n)}),
t AS (SELECT *, sxy / sxx AS slope, sqrt(greatest(0, syy - sxy / sxx * sxy) / n) AS sigma FROM s WHERE n = {n})
SELECT symbol, day, round(slope, 6) AS slope, round(CASE WHEN syy < 1e-10 THEN 1 ELSE sxy * sxy / sxx / syy END, 6) AS r2, round(sigma, 6) AS sigma,
  CASE WHEN sigma > 0 THEN round((y - my - slope * (x - mx)) / sigma, 6) END AS place FROM t"""


@query(_channel(60))
def regression_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.regression_channel(bars_daily(spark, sf_dir), 60))


@query(_channel(250))
def regression_channel_250(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.regression_channel(bars_daily(spark, sf_dir), 250))


def swing_sql(wing: int, source: str = "bars") -> str:
    return f"""s AS (SELECT *, count(*) OVER l = {wing} AND count(*) OVER r = {wing} AS whole, max(high) OVER l AS hl, max(high) OVER r AS hr, min(low) OVER l AS ll, min(low) OVER r AS lr FROM {source}
  WINDOW l AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {wing} PRECEDING AND 1 PRECEDING), r AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {wing} FOLLOWING)),
swing AS (SELECT symbol, day, 'high' AS kind, high AS price FROM s WHERE whole AND high > hl AND high >= hr UNION ALL SELECT symbol, day, 'low', low FROM s WHERE whole AND low < ll AND low <= lr)"""


@query(f"WITH {BARS}, {swing_sql(5)} SELECT symbol, day, kind, round(price, 8) AS price FROM swing")
def fractal_swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.swings(bars_daily(spark, sf_dir), 5), "price")


@query(
    f"""WITH {BARS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r FROM bars) WHERE r <= 40),
s AS (SELECT *, count(*) OVER f = 5 AND high = max(high) OVER f AS is_high, count(*) OVER f = 5 AND low = min(low) OVER f AS is_low FROM b WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT symbol, day, is_high, is_low, round(high, 8) AS high, round(low, 8) AS low FROM s WHERE is_high OR is_low"""
)
def swing_levels_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.swings_with_ties(bars_daily(spark, sf_dir)), "high", "low")


@query(
    f"""WITH {BARS}, {swing_sql(5)}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY day DESC) AS r FROM swing),
p AS (SELECT symbol, max(price) FILTER (WHERE kind = 'high' AND r = 1) AS high_1, max(price) FILTER (WHERE kind = 'high' AND r = 2) AS high_2, max(price) FILTER (WHERE kind = 'low' AND r = 1) AS low_1, max(price) FILTER (WHERE kind = 'low' AND r = 2) AS low_2 FROM r GROUP BY symbol)
SELECT symbol, round(high_1, 8) AS high_1, round(high_2, 8) AS high_2, round(low_1, 8) AS low_1, round(low_2, 8) AS low_2, CASE WHEN high_1 > high_2 AND low_1 > low_2 THEN 'up' WHEN high_1 < high_2 AND low_1 < low_2 THEN 'down' ELSE 'mixed' END AS state FROM p"""
)
def dow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ops.dow_state(ops.swings(bars_daily(spark, sf_dir), 5))
    return rounded(df, "high_1", "high_2", "low_1", "low_2")


@query(
    f"""WITH {BARS}, r AS (SELECT *, ln(close / lag(close) OVER w) AS r FROM bars {_W}),
v AS (SELECT symbol, day, close, stddev_pop(r) OVER {frame(63)} AS s, stddev_pop(r) OVER {frame(252)} AS s2, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM r)
SELECT symbol, CAST(h AS INTEGER) AS horizon, round(s * sqrt(252), 6) AS sigma_year, round(s2 * sqrt(252), 6) AS sigma_year_252, round(close * exp(-1.2815515655446004 * s * sqrt(h)), 6) AS p10, round(close, 6) AS p50,
  round(close * exp(1.2815515655446004 * s * sqrt(h)), 6) AS p90 FROM v, (SELECT unnest([21, 63, 126]) AS h) WHERE k = 1"""
)
def base_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.cone(bars_daily(spark, sf_dir)))


@query(
    f"""WITH {BARS}, d0 AS (SELECT *, ln(close / lag(close) OVER w) AS r, ln(close) AS y, CAST(row_number() OVER w AS DOUBLE) AS x, close - lag(close) OVER w AS d, close / lag(close, 5) OVER w - 1 AS r5 FROM bars {_W}),
d1 AS (SELECT *, avg(greatest(d, 0)) OVER {frame(14)} AS up, avg(greatest(-d, 0)) OVER {frame(14)} AS down FROM d0), d AS (SELECT *, (100 - 100 / (1 + up / CASE WHEN down = 0 THEN 1e-9 ELSE down END) - 50) / 50 AS rsi FROM d1),
e AS (SELECT *, stddev_pop(close) OVER {frame(20)} AS sd, avg(close) OVER {frame(20)} AS m20, list(close) OVER {frame(60)} AS c60 FROM d)
SELECT * EXCLUDE (x) FROM (SELECT symbol, day, x, {", ".join(f"round(close / lag(close, {k}) OVER w - 1, 6) AS return_{k}" for k in (10, 40))}, {", ".join(f"round(close / avg(close) OVER {frame(n)} - 1, 6) AS sma_distance_{n}" for n in (20, 100, 200))},
  round(CASE WHEN sd > 1e-12 THEN (close - m20) / sd ELSE 0 END, 6) AS zscore_20, round(len(list_filter(c60, lambda v: v <= close)) / 60.0::DOUBLE, 6) AS percentile_60,
  {", ".join(f"round(stddev_pop(r) OVER {frame(a)} / greatest(stddev_pop(r) OVER {frame(b)}, 1e-12), 6) AS vol_{a}_over_{b}" for a, b in ((5, 20), (20, 60)))}, round(rsi - lag(rsi, 5) OVER w, 6) AS rsi_slope_5, round(r5 - lag(r5, 5) OVER w, 6) AS momentum_acceleration, round(regr_sxy(y, x) OVER {frame(20)} / regr_sxx(y, x) OVER {frame(20)}, 6) AS log_slope_20 FROM e {_W}) WHERE x > 200"""
)
def engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.engineered(bars_daily(spark, sf_dir)))


@query(
    f"""WITH {BARS}, d AS (SELECT symbol, day, close / lag(close, 20) OVER w - 1 AS x FROM bars {_W}),
s AS (SELECT *, stddev_pop(x) OVER f AS sd, count(x) OVER f AS n FROM d WINDOW f AS {frame(252)})
SELECT symbol, day, CASE WHEN n >= 20 THEN round(CASE WHEN sd < 1e-12 THEN 0 ELSE least(1, greatest(-1, x / (2 * sd))) END, 6) END AS score FROM s"""
)
def volatility_scaled_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_daily(spark, sf_dir).withColumn("x", F.col("close") / F.lag("close", 20).over(ops.ordered()) - 1)
    return all_rounded(b.select("symbol", "day", ops.scaled_score(F.col("x"), 252).alias("score")))


@query(
    f"""WITH {BARS}, m AS (SELECT symbol, CAST(date_trunc('month', day) AS DATE) AS bucket, arg_max(close, day) AS close FROM bars GROUP BY 1, 2)
SELECT symbol, bucket, round(lag(close, 1) OVER w / lag(close, 12) OVER w - 1, 6) AS momentum_12_1 FROM m WINDOW w AS (PARTITION BY symbol ORDER BY bucket)"""
)
def momentum_12_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from ..operators.bars import aggregate

    w = Window.partitionBy("symbol").orderBy("bucket")
    m = aggregate(bars_daily(spark, sf_dir), "month")
    return m.select("symbol", "bucket", F.round(F.lag("close", 1).over(w) / F.lag("close", 12).over(w) - 1, 6).alias("momentum_12_1"))
