"""Queries over recursive indicators and sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import windows as win
from ..sources.tables import BARS, HOURS, bars_daily, bars_hourly
from .registry import query
from .windows import all_rounded


def _indicators(bars: DataFrame) -> DataFrame:
    b = bars.select("symbol", "day", "high", "low", "close")
    return b.groupBy("symbol").applyInPandas(kernels.indicators, f"{b._jdf.schema().toDDL()}, {kernels.INDICATORS}")


_N = "n_ AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day))"


@query(
    f"""WITH RECURSIVE {BARS}, {_N}, e AS (SELECT symbol, i, day, close AS a, close AS b, 0::DOUBLE AS s FROM n_ WHERE i = 1 UNION ALL
  SELECT n_.symbol, n_.i, n_.day, a + 2.0::DOUBLE / 13 * (close - a), b + 2.0::DOUBLE / 27 * (close - b), s + 0.2::DOUBLE * ((a + 2.0::DOUBLE / 13 * (close - a)) - (b + 2.0::DOUBLE / 27 * (close - b)) - s) FROM e JOIN n_ ON n_.symbol = e.symbol AND n_.i = e.i + 1)
SELECT symbol, day, round(a, 4) AS ema_12, round(b, 4) AS ema_26, round(a - b, 4) AS macd, round(s, 4) AS signal, round(a - b - s, 4) AS histogram FROM e"""
)
def ema_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(_indicators(bars_daily(spark, sf_dir)).select("symbol", "day", "ema_12", "ema_26", "macd", "signal", "histogram"), 4)


@query(
    f"""WITH RECURSIVE {BARS}, {_N}, seed AS (SELECT symbol, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM n_ WHERE i BETWEEN 2 AND 15 GROUP BY symbol),
r AS (SELECT n_.symbol, i, day, seed.g, seed.l FROM n_ JOIN seed ON seed.symbol = n_.symbol WHERE i = 15 UNION ALL SELECT n_.symbol, n_.i, n_.day, (g * 13 + greatest(d, 0)) / 14, (l * 13 + greatest(-d, 0)) / 14 FROM r JOIN n_ ON n_.symbol = r.symbol AND n_.i = r.i + 1),
q AS (SELECT symbol, i, day, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM n_ WHERE i = 2 UNION ALL SELECT n_.symbol, n_.i, n_.day, g + (greatest(d, 0) - g) / 14, l + (greatest(-d, 0) - l) / 14 FROM q JOIN n_ ON n_.symbol = q.symbol AND n_.i = q.i + 1),
s AS (SELECT symbol, day, round(CASE WHEN l > 1e-12 THEN 100 - 100 / (1 + g / l) WHEN g > 1e-12 THEN 100 ELSE 50 END, 4) AS rsi_seeded FROM r),
t AS (SELECT symbol, day, i, round(CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) ELSE 100 END, 4) AS rsi_ewm FROM q)
SELECT s.symbol, s.day, rsi_seeded, rsi_ewm FROM s JOIN t ON s.symbol = t.symbol AND s.day = t.day"""
)
def rsi_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both Wilder variants from where each is defined; the simple one is part of the gold features."""
    return all_rounded(_indicators(bars_daily(spark, sf_dir)).where("rsi_seeded IS NOT NULL AND NOT isnan(rsi_seeded)").select("symbol", "day", "rsi_seeded", "rsi_ewm"), 4)


@query(
    f"""WITH RECURSIVE {BARS}, {_N}, m AS (SELECT *, high - lag(high) OVER w AS u, lag(low) OVER w - low AS v FROM n_ WINDOW w AS (PARTITION BY symbol ORDER BY day)),
dm AS (SELECT *, CASE WHEN u > v AND u > 0 THEN u ELSE 0 END AS pdm, CASE WHEN v > u AND v > 0 THEN v ELSE 0 END AS mdm FROM m),
r AS (SELECT symbol, i, day, tr AS a, 0::DOUBLE AS p, 0::DOUBLE AS q, NULL::DOUBLE AS x FROM dm WHERE i = 1 UNION ALL
  SELECT symbol, i, day, a, p, q, CASE WHEN p + q > 0 THEN coalesce(x + (100 * abs(p - q) / (p + q) - x) / 14, 100 * abs(p - q) / (p + q)) ELSE x END FROM (
    SELECT dm.symbol, dm.i, dm.day, a + (tr - a) / 14 AS a, p + (pdm - p) / 14 AS p, q + (mdm - q) / 14 AS q, x FROM r JOIN dm ON dm.symbol = r.symbol AND dm.i = r.i + 1))
SELECT symbol, day, round(a, 4) AS atr, CASE WHEN a > 0 THEN round(100 * p / a, 4) END AS plus_di, CASE WHEN a > 0 THEN round(100 * q / a, 4) END AS minus_di, round(x, 4) AS adx FROM r"""
)
def atr_adx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is unknown until there has been a directional movement, and smoothed from then on."""
    return all_rounded(_indicators(bars_daily(spark, sf_dir)).select("symbol", "day", "atr", "plus_di", "minus_di", "adx"), 4)


@query(
    f"""WITH RECURSIVE {BARS}, {_N}, m AS (SELECT *, high - lag(high) OVER w AS u, lag(low) OVER w - low AS v FROM n_ WINDOW w AS (PARTITION BY symbol ORDER BY day)),
dm AS (SELECT symbol, i, CASE WHEN u > v AND u > 0 THEN u ELSE 0 END AS pdm, CASE WHEN v > u AND v > 0 THEN v ELSE 0 END AS mdm FROM m WHERE i > 1),
r AS (SELECT symbol, 15::BIGINT AS i, sum(pdm)::DOUBLE AS p, sum(mdm)::DOUBLE AS q FROM dm WHERE i <= 15 GROUP BY symbol UNION ALL
  SELECT dm.symbol, dm.i, p - p / 14 + pdm, q - q / 14 + mdm FROM r JOIN dm ON dm.symbol = r.symbol AND dm.i = r.i + 1)
SELECT symbol, round(avg(CASE WHEN p + q > 0 THEN 100 * abs(p - q) / (p + q) ELSE 0 END), 4) AS adx FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS k, max(i) OVER (PARTITION BY symbol) AS n FROM r) WHERE k <= 14 AND n >= 29 GROUP BY symbol"""
)
def adx_wilder_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    def last(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("day", ignore_index=True)
        return pd.DataFrame({"symbol": [b["symbol"].iloc[0]], "adx": [round(kernels.adx_sums(b), 4)]})

    return bars_daily(spark, sf_dir).groupBy("symbol").applyInPandas(last, "symbol string, adx double")


@query(
    f"""WITH {HOURS}, d AS (SELECT *, CAST(ts AS DATE) AS day FROM hours), s AS (SELECT symbol, day, count(*) AS bars, arg_min(c, ts) AS first, arg_max(c, ts) AS last, sum(v) AS v FROM d GROUP BY 1, 2)
SELECT symbol, day, bars, round(last / first - 1, 6) AS drift, CAST(v AS BIGINT) AS v, max(bars) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longest_before FROM s"""
)
def session_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions are UTC days; the longest one before says how many bars are still to come."""
    h = bars_hourly(spark, sf_dir).withColumn("day", F.to_date("ts"))
    s = h.groupBy("symbol", "day").agg(F.count("*").alias("bars"), F.round(F.max_by("c", "ts") / F.min_by("c", "ts") - 1, 6).alias("drift"), F.sum("v").alias("v"))
    return s.withColumn("longest_before", F.max("bars").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)))


@query(
    f"""WITH {HOURS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM hours),
m AS (SELECT symbol, list_sort(list(v))[len(list(v)) // 2 + 1] AS upper_median FROM hours GROUP BY symbol)
SELECT symbol, upper_median FROM m"""
)
def upper_median_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element at n // 2 of the sorted volumes, found by ranks and not by gathering them."""
    counts = bars_hourly(spark, sf_dir).groupBy("symbol", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("symbol")
    upto, all_ = F.sum("n").over(w.orderBy("v")), F.sum("n").over(w)
    c = counts.select("symbol", "v", upto.alias("upto"), F.floor(all_ / 2).alias("at"))
    return c.where("upto > at").groupBy("symbol").agg(F.min("v").alias("upper_median"))
