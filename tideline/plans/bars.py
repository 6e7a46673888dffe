"""Queries over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as ops
from ..sources.tables import BARS, bars_daily
from .registry import query

_OHLC = "round({0}, 8) AS {0}"
_ROUNDED = ", ".join(_OHLC.format(c) for c in ("open", "high", "low", "close"))


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_RESAMPLE = f"""WITH {BARS} SELECT symbol, {{0}} AS label, round(arg_min(open, day), 8) AS open, round(max(high), 8) AS high, round(min(low), 8) AS low,
  round(arg_max(close, day), 8) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, {{0}}"""


@query(_RESAMPLE.format("CAST(day + CAST((5 - isodow(day) + 7) % 7 AS INTEGER) AS DATE)"))
def resample_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.resample(bars_daily(spark, sf_dir), ops.week_ending_friday(F.col("day"))), "open", "high", "low", "close")


@query(_RESAMPLE.format("last_day(day)"))
def resample_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.resample(bars_daily(spark, sf_dir), F.last_day("day")), "open", "high", "low", "close")


_BUCKETS = f"""WITH {BARS} SELECT symbol, CAST({{0}} AS DATE) AS bucket, min(day) AS day, round(max(high), 8) AS high, round(min(low), 8) AS low,
  round(arg_max(close, day), 8) AS close, count(*) AS n_bars FROM bars GROUP BY symbol, {{0}}"""


@query(_BUCKETS.format("date_trunc('week', day)"))
def aggregate_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.aggregate(bars_daily(spark, sf_dir), "week"), "high", "low", "close")


@query(_BUCKETS.format("date_trunc('quarter', day)"))
def aggregate_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.aggregate(bars_daily(spark, sf_dir), "quarter"), "high", "low", "close")


@query(_BUCKETS.format("CASE WHEN month(day) <= 6 THEN date_trunc('year', day) ELSE date_trunc('year', day) + INTERVAL 6 MONTH END"))
def aggregate_halfyear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.aggregate(bars_daily(spark, sf_dir), "half"), "high", "low", "close")


_LAST = f"""WITH {BARS}, p AS (SELECT symbol, CAST(date_trunc('{{0}}', day) AS DATE) AS bucket, max(high) AS high, min(low) AS low, arg_max(close, day) AS close, count(*) AS n_bars FROM bars GROUP BY 1, 2)
SELECT symbol, bucket, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, n_bars FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) AS r FROM p WHERE {{1}} <= DATE '1998-06-18') WHERE r = 1"""


@query(_LAST.format("week", "bucket + 5"))
def last_complete_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.last_complete(bars_daily(spark, sf_dir), "week", F.lit("1998-06-18").cast("date")), "high", "low", "close")


@query(_LAST.format("month", "CAST(bucket + INTERVAL 1 MONTH AS DATE)"))
def last_complete_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.last_complete(bars_daily(spark, sf_dir), "month", F.lit("1998-06-18").cast("date")), "high", "low", "close")


@query(
    f"""WITH {BARS}, c AS (SELECT symbol, day, high, low, close, coalesce(lag(close) OVER w, close) AS open,
  CAST(row_number() OVER w - count(*) OVER (PARTITION BY symbol) AS INTEGER) AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, day, round(open, 8) AS open, round(greatest(high, open, close), 8) AS high, round(least(low, open, close), 8) AS low, round(close, 8) AS close, i, close >= open AS up FROM c"""
)
def chart_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.candles(bars_daily(spark, sf_dir)), "open", "high", "low", "close")


@query(f"WITH {BARS}, b AS (SELECT symbol, day, CASE WHEN dayofmonth(day) = 13 THEN -high ELSE high END AS high, low, close FROM bars) SELECT symbol, day, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close FROM b WHERE NOT (high > 0 AND low > 0 AND close > 0 AND low <= close AND close <= high)")
def ohlc_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 13th of a month is spoiled before the check."""
    b = bars_daily(spark, sf_dir).select("symbol", "day", F.when(F.dayofmonth("day") == 13, -F.col("high")).otherwise(F.col("high")).alias("high"), "low", "close")
    return rounded(ops.ohlc_violations(b), "high", "low", "close")


@query("SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 20")
def duplicate_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import table

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("day"))
    return rows.groupBy("symbol", "day").agg(F.count("*").alias("n")).where("n > 20")


@query(
    f"""WITH {BARS}, c AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r, {", ".join(f"round(close / lag(close, {k}) OVER (PARTITION BY symbol ORDER BY day) - 1, 8) AS change_{k}" for k in (1, 5, 21, 63, 126, 252))} FROM bars)
SELECT * EXCLUDE (r) FROM c WHERE r = 1"""
)
def period_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ops.period_changes(bars_daily(spark, sf_dir))
    return rounded(df, *[c for c in df.columns if c.startswith("change")])


@query(
    f"""WITH {BARS}, s AS (SELECT day, close AS spot FROM bars WHERE symbol = 'A' AND dayofyear(day) % 7 <> 0), f AS (SELECT day, close AS futures FROM bars WHERE symbol = 'N'),
j AS (SELECT coalesce(s.day, f.day) AS day, spot, futures, CASE WHEN spot IS NOT NULL AND futures IS NOT NULL THEN futures / spot END AS basis FROM s FULL JOIN f ON s.day = f.day)
SELECT day, round(spot, 8) AS spot, round(futures, 8) AS futures, round(basis, 8) AS basis, round(last_value(basis IGNORE NULLS) OVER (ORDER BY day), 8) AS basis_filled FROM j"""
)
def price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_daily(spark, sf_dir)
    spot = b.where((F.col("symbol") == "A") & (F.dayofyear("day") % 7 != 0)).select("day", F.col("close").alias("spot"))
    return rounded(ops.full_outer(spot, b.where("symbol = 'N'").select("day", F.col("close").alias("futures"))), "spot", "futures", "basis", "basis_filled")


@query(f"WITH {BARS} SELECT day, round(max(close) FILTER (WHERE symbol = 'A'), 8) AS a, round(max(close) FILTER (WHERE symbol = 'N'), 8) AS n, round(max(close) FILTER (WHERE symbol = 'R'), 8) AS r FROM bars GROUP BY day")
def market_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols by day: one shuffle by pivot instead of a chain of outer joins."""
    wide = bars_daily(spark, sf_dir).groupBy("day").pivot("symbol", ["A", "N", "R"]).agg(F.max("close"))
    return rounded(wide.toDF("day", "a", "n", "r"), "a", "n", "r")


@query(
    f"""WITH {BARS}, m AS (SELECT symbol, date_trunc('month', day) AS b, arg_max(close, day) AS close, row_number() OVER (PARTITION BY symbol ORDER BY date_trunc('month', day) DESC) AS r FROM bars GROUP BY symbol, date_trunc('month', day))
SELECT symbol, count(*) AS n, round(arg_max(close, b) / arg_min(close, b) - 1, 8) AS change FROM m WHERE r <= 12 GROUP BY symbol"""
)
def visible_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised change over the last twelve monthly buckets."""
    from pyspark.sql import Window

    m = ops.aggregate(bars_daily(spark, sf_dir), "month")
    m = m.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bucket")))).where("r <= 12")
    return m.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.max_by("close", "bucket") / F.min_by("close", "bucket") - 1, 8).alias("change"))
