"""The trend of each symbol in one row: structure, averages, strength, lines and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import levels, windows

CHANNELS = (60, 120, 250)


def report(bars: DataFrame, strength: DataFrame, wing: int = 5, ahead: int = 5) -> DataFrame:
    """One row for each symbol of ``bars``; ``strength`` has (symbol, day, atr, adx).

    Averages are null while they lack bars; a line is given by its value on the last
    bar and ``ahead`` bars on, and by whether a close has broken it; a channel by its
    slope, fit and the last close's place in deviations. ``last_low`` and
    ``last_high`` undo the trend when passed; ``swings`` are the last eight, oldest
    first. Parts that a symbol is too short for are null.
    """
    latest = lambda df, *columns: df.groupBy("symbol").agg(F.max_by(F.struct(*columns), "day").alias("r")).select("symbol", *(F.col(f"r.{c}").alias(c) for c in columns))
    swing = windows.swings(bars, wing)
    base = bars.groupBy("symbol").agg(F.max("day").alias("day"), F.max_by("close", "day").alias("price"), F.count("*").alias("bars"))
    averages = latest(windows.moving_averages(bars, (50, 200)), "sma_50", "sma_200")
    out = base.join(averages, "symbol").join(latest(strength, "atr", "adx"), "symbol", "left")
    out = out.join(windows.dow_state(swing), "symbol", "left").withColumnRenamed("state", "structure")
    for n in CHANNELS:
        channel = latest(windows.regression_channel(bars, n), "slope", "r2", "place")
        out = out.join(channel.toDF("symbol", *(f"{c}_{n}" for c in ("slope", "r2", "place"))), "symbol", "left")
    lines = levels.trend_lines(swing, bars)
    rise = (F.col("pb") - F.col("pa")) / (F.col("xb") - F.col("xa"))
    for kind, name in (("low", "support"), ("high", "resistance")):
        own = lines.where(F.col("kind") == kind).select("symbol", "xa", "pa", rise.alias("rise"), (F.col("broken") == 1).alias(f"{name}_broken"))
        at = lambda more: F.col("pa") + F.col("rise") * (F.col("bars") + more - F.col("xa"))
        out = out.join(own, "symbol", "left").withColumns({name: at(0), f"{name}_ahead": at(ahead)}).drop("xa", "pa", "rise")
    r = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day"), "kind"))
    tail = swing.withColumn("r", r).where("r <= 8").groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("r"), F.concat(F.substring("kind", 1, 1), F.lit(" "), F.col("day").cast("string")).alias("s")))), lambda x: x["s"]), ", ").alias("swings"))
    out = out.join(tail, "symbol", "left")
    return out.select(
        "symbol", "day", "price", "atr", (0.5 * F.col("atr")).alias("tolerance"), "adx", "structure", F.col("low_1").alias("last_low"), F.col("high_1").alias("last_high"),
        *((F.col("price") / F.col(f"sma_{n}") - 1).alias(f"from_sma_{n}") for n in (50, 200)), (F.col("sma_50") > F.col("sma_200")).alias("sma_50_above"),
        "support", "support_ahead", "support_broken", "resistance", "resistance_ahead", "resistance_broken", *(f"{c}_{n}" for n in CHANNELS for c in ("slope", "r2", "place")), "swings",
    )
