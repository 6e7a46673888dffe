"""Queries over as-of, point-in-time and set joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof
from ..sources.tables import BARS, FORECASTS, MACRO, bars_daily, forecasts, macro_observations, table
from .bars import rounded
from .registry import query

SERIES = "1-URGENT"
_FIRST = "first AS (SELECT series, obs_date AS day, value FROM macro WHERE vintage = 'initial')"
_ALL_DAYS = "days AS (SELECT DISTINCT b.day, s.series FROM bars b, (SELECT DISTINCT series FROM first) s)"
_DAYS = f"days AS (SELECT DISTINCT day, '{SERIES}' AS series FROM bars)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).select("day").distinct().withColumn("series", F.lit(SERIES))


def _all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).select("day").distinct().crossJoin(_first(spark, sf_dir).select("series").distinct())


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_observations(spark, sf_dir).where("vintage = 'initial'").select("series", F.col("obs_date").alias("day"), "value")


@query(f"WITH {BARS}, {MACRO}, {_FIRST}, {_DAYS} SELECT d.series, d.day, f.value, f.day AS seen FROM days d ASOF LEFT JOIN first f ON d.series = f.series AND d.day >= f.day")
def macro_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.backward(_days(spark, sf_dir), _first(spark, sf_dir), ["series"], "day", "value")


@query(
    f"""WITH {BARS}, {MACRO}, {_FIRST}, {_DAYS}, n AS (SELECT d.series, d.day, f.value FROM days d ASOF LEFT JOIN first f ON d.series = f.series AND d.day >= f.day),
b AS (SELECT d.series, d.day, f.value AS before FROM days d ASOF LEFT JOIN first f ON d.series = f.series AND d.day - 90 >= f.day)
SELECT n.series, n.day, value, before, round(value - before, 6) AS difference, round(value / nullif(before, 0) - 1, 6) AS ratio FROM n JOIN b ON n.series = b.series AND n.day = b.day"""
)
def macro_change_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(asof.change(_days(spark, sf_dir), _first(spark, sf_dir), ["series"], "day", "value", 90), "difference", "ratio", digits=6)


@query(f"WITH {BARS}, {MACRO}, {_FIRST}, {_ALL_DAYS} SELECT d.series, d.day, f.value, f.day AS seen FROM days d ASOF LEFT JOIN first f ON d.series = f.series AND d.day >= f.day")
def macro_asof_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All series, where ``macro_asof`` and its SQL probe one."""
    return asof.backward(_all_days(spark, sf_dir), _first(spark, sf_dir), ["series"], "day", "value")


@query(
    f"""WITH {BARS}, {MACRO}, {_FIRST}, {_ALL_DAYS}, n AS (SELECT d.series, d.day, f.value FROM days d ASOF LEFT JOIN first f ON d.series = f.series AND d.day >= f.day),
b AS (SELECT d.series, d.day, f.value AS before FROM days d ASOF LEFT JOIN first f ON d.series = f.series AND d.day - 90 >= f.day)
SELECT n.series, n.day, value, before, round(value - before, 6) AS difference, round(value / nullif(before, 0) - 1, 6) AS ratio FROM n JOIN b ON n.series = b.series AND n.day = b.day"""
)
def macro_change_ratio_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All series, where ``macro_change_ratio`` and its SQL probe one."""
    return rounded(asof.change(_all_days(spark, sf_dir), _first(spark, sf_dir), ["series"], "day", "value", 90), "difference", "ratio", digits=6)


@query(
    f"""WITH {MACRO}, p AS (SELECT DISTINCT series, CAST(obs_date + 100 AS TIMESTAMP) AS known_at, obs_date + 60 AS cutoff FROM macro),
r AS (SELECT p.*, m.obs_date, m.available_at, m.value, row_number() OVER (PARTITION BY p.series, p.known_at, p.cutoff ORDER BY m.obs_date DESC, m.available_at DESC) AS k
  FROM p LEFT JOIN macro m ON m.series = p.series AND m.available_at <= p.known_at AND m.obs_date <= p.cutoff)
SELECT series, known_at, cutoff, obs_date, available_at, value FROM r WHERE k = 1"""
)
def pit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = macro_observations(spark, sf_dir)
    p = m.select("series", F.date_add("obs_date", 100).cast("timestamp").alias("known_at"), F.date_add("obs_date", 60).alias("cutoff"))
    return asof.point_in_time(p, m, ["series"], "known_at", "cutoff")


@query(
    f"""WITH {MACRO}, k AS (SELECT series, obs_date, arg_max(value, available_at) AS value FROM macro WHERE available_at <= TIMESTAMP '1997-06-30' GROUP BY 1, 2)
SELECT a.series, a.obs_date, a.value, b.value AS before, round(a.value / nullif(b.value, 0) - 1, 6) AS yoy FROM k a JOIN k b ON a.series = b.series AND b.obs_date = CAST(a.obs_date - INTERVAL 12 MONTH AS DATE)"""
)
def pit_year_on_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.lit("1997-06-30 00:00:00").cast("timestamp")
    return rounded(asof.year_on_year(macro_observations(spark, sf_dir), ["series"], known), "yoy", digits=6)


LABELS = f"""probes AS (SELECT symbol, day, close, CAST(h AS INTEGER) AS horizon, day + CAST(h AS INTEGER) AS due FROM bars, (SELECT unnest([7, 14, 30]) AS h)),
labels_ AS (SELECT p.symbol, p.day, p.horizon, b.day AS target_day, b.close / p.close - 1 AS target_return FROM probes p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.due <= b.day)"""


@query(f"WITH {BARS}, {LABELS} SELECT symbol, day, horizon, target_day, round(target_return, 6) AS target_return FROM labels_")
def forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(asof.forward_return(bars_daily(spark, sf_dir)), "target_return", digits=6)


@query(
    f"""WITH {BARS}, {FORECASTS}, spot AS (SELECT day, close FROM bars WHERE symbol = 'N'),
f AS (SELECT *, origin + horizon AS due FROM forecasts), j AS (SELECT f.id, f.due, s.day AS settled, s.close AS price FROM f ASOF LEFT JOIN spot s ON f.due <= s.day)
SELECT id, due, settled, round(price, 8) AS price FROM j WHERE settled - due <= 7"""
)
def forecast_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts settle at the first close on or after they are due, within seven days."""
    f = forecasts(spark, sf_dir).select("id", F.date_add("origin", F.col("horizon")).alias("due"), F.lit("N").alias("symbol"))
    spot = bars_daily(spark, sf_dir).where("symbol = 'N'").select("symbol", F.col("day").alias("due"), F.col("close").alias("price"))
    hits = asof.forward(f, spot, ["symbol"], "due", "price").where(F.datediff("seen", "due") <= 7)
    return rounded(f.join(hits, ["symbol", "due"]).select("id", "due", F.col("seen").alias("settled"), "price"), "price")


_AS_OF = "1998-06-30"


@query(
    f"""WITH {FORECASTS}, {BARS}, outcomes AS (SELECT f.id FROM forecasts f JOIN bars b ON b.symbol = 'A' AND b.day = f.origin + f.horizon WHERE b.day <= DATE '{_AS_OF}')
SELECT id, origin, horizon FROM forecasts f WHERE origin <= DATE '{_AS_OF}' AND NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.id = f.id)"""
)
def unresolved_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join: forecasts issued by a day that have no outcome by then, as their due day has had no bar."""
    days = bars_daily(spark, sf_dir).where((F.col("symbol") == "A") & (F.col("day") <= _AS_OF)).select(F.col("day").alias("due"))
    f = forecasts(spark, sf_dir).where(F.col("origin") <= _AS_OF).select("id", "origin", "horizon", F.date_add("origin", F.col("horizon")).alias("due"))
    outcomes = f.join(days, "due", "left_semi").select("id")
    return f.join(outcomes, "id", "left_anti").select("id", "origin", "horizon")


@query(f"WITH {FORECASTS}, {BARS} SELECT id FROM forecasts f WHERE EXISTS (SELECT 1 FROM bars b WHERE b.symbol = 'A' AND b.day = f.origin + f.horizon)")
def observed_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join: forecasts whose due day has a bar."""
    days = bars_daily(spark, sf_dir).where("symbol = 'A'").select(F.col("day").alias("due"))
    f = forecasts(spark, sf_dir).select("id", F.date_add("origin", F.col("horizon")).alias("due"))
    return f.join(days, "due", "left_semi").select("id")


@query(
    f"""WITH {MACRO}, l AS (SELECT series, max(obs_date) AS obs_date, arg_max(value, (obs_date, available_at)) AS value, count(*) AS n FROM macro GROUP BY series)
SELECT series, obs_date, value, n, CAST(DATE '1998-12-31' - obs_date AS INTEGER) AS age_days, CASE substr(series, 1, 1) WHEN '1' THEN 15 WHEN '2' THEN 30 ELSE 45 END AS lag_days FROM l"""
)
def latest_with_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value of each series, joined with a small table of lags that the optimiser broadcasts by its size."""
    m = macro_observations(spark, sf_dir)
    latest = m.groupBy("series").agg(F.max(F.struct("obs_date", "available_at", "value")).alias("b"), F.count("*").alias("n"))
    meta = spark.createDataFrame([("1", 15), ("2", 30), ("3", 45), ("4", 45), ("5", 45)], "code string, lag_days int")
    out = latest.withColumn("code", F.substring("series", 1, 1)).join(meta, "code", "left")
    return out.select("series", "b.obs_date", "b.value", "n", F.datediff(F.lit("1998-12-31").cast("date"), "b.obs_date").alias("age_days"), "lag_days")


@query(
    f"""WITH {BARS}, b AS (SELECT symbol, day, max(day + CAST(dayofmonth(day) % 3 AS INTEGER)) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS last, count(*) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM bars)
SELECT symbol, day, last <= day + 1 AS available FROM b WHERE n = 61"""
)
def price_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all of the last 61 bars are available the day after; a bar is so up to two days late."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-60, 0)
    b = bars_daily(spark, sf_dir).select("symbol", "day", F.date_add("day", F.dayofmonth("day") % 3).alias("at"))
    b = b.select("symbol", "day", F.max("at").over(w).alias("last"), F.count("*").over(w).alias("n"))
    return b.where("n = 61").select("symbol", "day", (F.col("last") <= F.date_add("day", 1)).alias("available"))


@query("SELECT p_partkey AS id, CAST(req AS INTEGER) AS asked, CAST(CASE WHEN req <= 10 THEN 7 WHEN req <= 22 THEN 14 ELSE 30 END AS INTEGER) AS horizon FROM (SELECT p_partkey, p_size % 40 AS req FROM part)")
def nearest_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon nearest to the one asked for; the first of equally near ones."""
    near = F.array_min(F.transform(F.array(F.lit(7), F.lit(14), F.lit(30)), lambda h: F.struct(F.abs(h - F.col("asked")).alias("gap"), h.alias("h"))))["h"]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 40).alias("asked")).withColumn("horizon", near)


_LAG = "CASE substr(series, 1, 1) WHEN '1' THEN 45 WHEN '2' THEN 10 ELSE 2 END"


@query(
    f"""WITH {BARS}, {MACRO}, {_FIRST}, {_ALL_DAYS}, lagged AS (SELECT *, {_LAG} AS lag FROM days), n AS (SELECT d.series, d.day, f.value FROM lagged d ASOF LEFT JOIN first f ON d.series = f.series AND d.day >= f.day),
b AS (SELECT d.series, d.day, f.value AS before FROM (SELECT *, day - CAST(lag AS INTEGER) AS at_ FROM lagged) d ASOF LEFT JOIN first f ON d.series = f.series AND d.at_ >= f.day)
SELECT n.series, n.day, value, before, round(value - before, 6) AS difference, round(value / nullif(before, 0) - 1, 6) AS ratio FROM n JOIN b ON n.series = b.series AND n.day = b.day"""
)
def macro_change_by_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes over each series' own look-back: 45, 10 or 2 days."""
    lag = F.expr(_LAG)
    return rounded(asof.change(_all_days(spark, sf_dir), _first(spark, sf_dir), ["series"], "day", "value", lag), "difference", "ratio", digits=6)
