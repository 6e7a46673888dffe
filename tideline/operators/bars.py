"""Bars: resampling, buckets, completion, candles, and checks of their form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_ending_friday(day: Column) -> Column:
    return F.next_day(F.date_sub(day, 1), "FRI")


def bucket(day: Column, kind: str) -> Column:
    """The first day of the day, ISO week, month, quarter or half year that ``day`` lies in."""
    if kind == "day":
        return day
    if kind == "half":
        return F.when(F.month(day) <= 6, F.trunc(day, "year")).otherwise(F.add_months(F.trunc(day, "year"), 6))
    return F.trunc(day, kind)


def resample(bars: DataFrame, label: Column) -> DataFrame:
    """First open, highest high, lowest low, last close and summed volume of each symbol and label; nulls are skipped."""
    return bars.groupBy("symbol", label.alias("label")).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col("day"))).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("day"))).alias("close"),
        F.sum("volume").alias("volume"),
    )


def aggregate(bars: DataFrame, kind: str) -> DataFrame:
    """High, low and last close of each bucket, dated by the first day that has a bar."""
    return bars.groupBy("symbol", bucket(F.col("day"), kind).alias("bucket")).agg(
        F.min("day").alias("day"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "day").alias("close"), F.count("*").alias("n_bars")
    )


def last_complete(bars: DataFrame, kind: str, today: Column, days: DataFrame | None = None) -> DataFrame:
    """The last complete period of each symbol: an ISO week is complete from its Saturday on, a month from the next.

    With ``days`` (symbol, ...), ``today`` may be a column of it.
    """
    periods = aggregate(bars, kind)
    if days is not None:
        periods = periods.join(days, "symbol")
    done = F.date_add("bucket", 5) <= today if kind == "week" else F.add_months("bucket", 1) <= today
    row = F.struct("bucket", "high", "low", "close", "n_bars")
    return periods.where(done).groupBy("symbol").agg(F.max_by(row, "bucket").alias("p")).select("symbol", "p.*")


def candles(bars: DataFrame) -> DataFrame:
    """Chart candles: open is the close before, high and low include both; ``i`` ends at 0."""
    w = Window.partitionBy("symbol").orderBy("day")
    opened = F.coalesce(F.lag("close").over(w), F.col("close"))
    i = F.row_number().over(w) - F.count("*").over(Window.partitionBy("symbol"))
    c = bars.select("symbol", "day", opened.alias("open"), "high", "low", "close", i.cast("int").alias("i"))
    return c.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close"), "up": F.col("close") >= F.col("open")})


def finite_positive(x: str) -> Column:
    c = F.col(x)
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """Bars that are not finite, positive and low <= close <= high."""
    ok = finite_positive("high") & finite_positive("low") & finite_positive("close") & (F.col("low") <= F.col("close")) & (F.col("close") <= F.col("high"))
    return bars.where(~F.coalesce(ok, F.lit(False)))


def period_changes(bars: DataFrame, steps: tuple[int, ...] = (1, 5, 21, 63, 126, 252)) -> DataFrame:
    """Change of the last close against that of so many observations before."""
    w = Window.partitionBy("symbol").orderBy("day")
    cols = [F.col("close") / F.lag("close", k).over(w) - 1 for k in steps]
    rows = bars.select("symbol", "day", *(c.alias(f"change_{k}") for c, k in zip(cols, steps, strict=True)))
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*rows.columns[1:]), "day").alias("r")).select("symbol", "r.*")


def full_outer(spot: DataFrame, futures: DataFrame) -> DataFrame:
    """Spot and futures by day with their basis (futures over spot), carried forward where one is missing."""
    joined = spot.join(futures, "day", "full_outer")
    basis = F.when(F.col("spot").isNotNull() & F.col("futures").isNotNull(), F.col("futures") / F.col("spot"))
    joined = joined.withColumn("basis", basis).withColumn("year", F.year("day"))
    # carried within a year at first, then over the years' ends, so that no window holds all days
    w = Window.partitionBy("year").orderBy("day")
    within = joined.withColumn("basis_filled", F.last("basis", ignorenulls=True).over(w))
    ends = joined.groupBy("year").agg(F.max_by("basis", F.when(F.col("basis").isNotNull(), F.col("day"))).alias("last"))
    before = ends.select("year", F.last("last", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return within.join(before, "year").withColumn("basis_filled", F.coalesce("basis_filled", "carried")).drop("year", "carried")
