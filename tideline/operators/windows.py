"""Row-window indicators of bars, all partitioned by symbol and ordered by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered() -> Window:
    return Window.partitionBy("symbol").orderBy("day")


def last_rows(n: int) -> Window:
    """A frame of the last ``n`` rows with the current one."""
    return ordered().rowsBetween(-(n - 1), 0)


def full(x: Column, n: int) -> Column:
    """``x`` where the frame holds ``n`` rows, else null."""
    return F.when(F.count("*").over(last_rows(n)) == n, x)


def log_return() -> Column:
    return F.log(F.col("close") / F.lag("close").over(ordered()))


def true_range() -> Column:
    """The first bar's range is high - low; greatest() skips nulls."""
    before = F.lag("close").over(ordered())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def gold_features(bars: DataFrame) -> DataFrame:
    """Returns 1/5/20, distance from the 50-bar mean, simple RSI-14, simple ATR-14, annualised 20-bar volatility and 60-bar drawdown.

    These look back by bars. The first 60 bars of a symbol are warm-up and left out.
    """
    w = ordered()
    d = bars.withColumns({"r": log_return(), "tr": true_range(), "d": F.col("close") - F.lag("close").over(w), "n": F.row_number().over(w)})
    up, down = F.greatest("d", F.lit(0.0)), F.greatest(-F.col("d"), F.lit(0.0))
    gains, losses = F.avg(up).over(last_rows(14)), F.avg(down).over(last_rows(14))
    rsi = 100 - 100 / (1 + gains / F.when(losses == 0, 1e-9).otherwise(losses))
    close = F.col("close")
    f = d.select(
        "symbol",
        "day",
        "n",
        "close",
        *((close / F.lag("close", k).over(w) - 1).alias(f"return_{k}") for k in (1, 5, 20)),
        (close / F.avg("close").over(last_rows(50)) - 1).alias("ma50_distance"),
        ((rsi - 50) / 50).alias("rsi14"),
        (F.avg("tr").over(last_rows(14)) / close).alias("atr14"),
        (F.stddev_pop("r").over(last_rows(20)) * F.sqrt(F.lit(252.0))).alias("volatility_20"),
        (close / F.max("close").over(last_rows(60)) - 1).alias("drawdown_60"),
    )
    return f.where("n > 60").drop("n")


def moving_averages(bars: DataFrame, lengths: tuple[int, ...] = (10, 20, 50, 100, 200)) -> DataFrame:
    return bars.select("symbol", "day", *(full(F.avg("close").over(last_rows(n)), n).alias(f"sma_{n}") for n in lengths))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Mean, population deviation and %B; null in the warm-up and where the deviation is 0."""
    mean, sd = F.avg("close").over(last_rows(n)), F.stddev_pop("close").over(last_rows(n))
    b = bars.select("symbol", "day", "close", full(mean, n).alias("middle"), full(sd, n).alias("sd"))
    return b.withColumn("pct_b", F.when(F.col("sd") > 0, (F.col("close") - (F.col("middle") - k * F.col("sd"))) / (2 * k * F.col("sd"))))


def oscillators(bars: DataFrame) -> DataFrame:
    """Stochastic %K and %D (14, 3), Williams %R 14, CCI 20 and rate of change 10, from the 210th bar of a symbol on."""
    hi, lo = F.max("high").over(last_rows(14)), F.min("low").over(last_rows(14))
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    b = bars.withColumns({"hi": hi, "lo": lo, "tp": tp, "n": F.row_number().over(ordered())})
    span = F.col("hi") - F.col("lo")
    b = b.withColumns({"k": F.when(span > 0, 100 * (F.col("close") - F.col("lo")) / span).otherwise(50.0), "tps": F.collect_list("tp").over(last_rows(20)), "mean": F.avg("tp").over(last_rows(20))})
    deviation = F.aggregate("tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("mean"))) / F.size("tps")
    b = b.select(
        "symbol",
        "day",
        "n",
        F.col("k").alias("stoch_k"),
        F.avg("k").over(last_rows(3)).alias("stoch_d"),
        F.when(span > 0, -100 * (F.col("hi") - F.col("close")) / span).otherwise(-50.0).alias("williams_r"),
        F.when(deviation > 0, (F.col("tp") - F.col("mean")) / (0.015 * deviation)).otherwise(0.0).alias("cci"),
        (100 * (F.col("close") / F.lag("close", 10).over(ordered()) - 1)).alias("roc"),
    )
    return b.where("n >= 210").drop("n")


def regression_channel(bars: DataFrame, n: int = 60) -> DataFrame:
    """Slope, r2 and sigma of ln(close) on the bar number over ``n`` bars, and the last close's place in sigmas."""
    b = bars.select("symbol", "day", F.log("close").alias("y"), F.row_number().over(ordered()).cast("double").alias("x"))
    w = last_rows(n)
    sxx, syy, sxy = F.regr_sxx("y", "x").over(w), F.regr_syy("y", "x").over(w), F.regr_sxy("y", "x").over(w)
    b = b.select("symbol", "day", "y", "x", F.avg("x").over(w).alias("mx"), F.avg("y").over(w).alias("my"), sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy"), F.count("*").over(w).alias("n"))
    slope = F.col("sxy") / F.col("sxx")
    b = b.where(F.col("n") == n).withColumns({"slope": slope, "r2": F.when(F.col("syy") < 1e-10, 1.0).otherwise(F.col("sxy") * F.col("sxy") / F.col("sxx") / F.col("syy"))})
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n"))
    b = b.withColumn("sigma", sigma)
    place = (F.col("y") - F.col("my") - F.col("slope") * (F.col("x") - F.col("mx"))) / F.col("sigma")
    return b.select("symbol", "day", "slope", "r2", "sigma", F.when(F.col("sigma") > 0, place).alias("place"))


def swings(bars: DataFrame, wing: int) -> DataFrame:
    """Highs above all ``wing`` bars to the left and not below those to the right, and lows likewise."""
    w = ordered()
    left, right = w.rowsBetween(-wing, -1), w.rowsBetween(1, wing)
    whole = (F.count("*").over(left) == wing) & (F.count("*").over(right) == wing)
    high = whole & (F.col("high") > F.max("high").over(left)) & (F.col("high") >= F.max("high").over(right))
    low = whole & (F.col("low") < F.min("low").over(left)) & (F.col("low") <= F.min("low").over(right))
    b = bars.withColumns({"is_high": high, "is_low": low})
    both = F.explode(F.array(F.struct(F.lit("high").alias("kind"), F.col("is_high").alias("is"), F.col("high").alias("price")), F.struct(F.lit("low").alias("kind"), F.col("is_low").alias("is"), F.col("low").alias("price"))))
    return b.select("symbol", "day", both.alias("s")).where("s.is").select("symbol", "day", "s.kind", "s.price")


def swings_with_ties(bars: DataFrame, wing: int = 2, last: int = 40) -> DataFrame:
    """Extremes of the ``wing`` bars on both sides, ties allowed, among the last bars of each symbol."""
    w = ordered().rowsBetween(-wing, wing)
    b = bars.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))).where(F.col("r") <= last)
    whole = F.count("*").over(w) == 2 * wing + 1
    b = b.withColumns({"is_high": whole & (F.col("high") == F.max("high").over(w)), "is_low": whole & (F.col("low") == F.min("low").over(w))})
    return b.where("is_high OR is_low").select("symbol", "day", "is_high", "is_low", "high", "low")


def dow_state(swing: DataFrame) -> DataFrame:
    """Uptrend if the last two highs and lows rise, downtrend if both fall, else mixed."""
    r = F.row_number().over(Window.partitionBy("symbol", "kind").orderBy(F.desc("day")))
    last = swing.withColumn("r", r).where("r <= 2").groupBy("symbol").agg(*(F.max(F.when((F.col("kind") == k) & (F.col("r") == i), F.col("price"))).alias(f"{k}_{i}") for k in ("high", "low") for i in (1, 2)))
    state = F.when((F.col("high_1") > F.col("high_2")) & (F.col("low_1") > F.col("low_2")), "up").when((F.col("high_1") < F.col("high_2")) & (F.col("low_1") < F.col("low_2")), "down").otherwise("mixed")
    return last.withColumn("state", state)


def cone(bars: DataFrame, horizons: tuple[int, ...] = (21, 63, 126)) -> DataFrame:
    """Realised 63-bar volatility and lognormal P10/P50/P90 of each horizon from the last close."""
    b = bars.withColumn("r", log_return())
    b = b.select("symbol", "day", "close", F.stddev_pop("r").over(last_rows(63)).alias("sigma"), F.stddev_pop("r").over(last_rows(252)).alias("sigma_252"))
    b = b.groupBy("symbol").agg(F.max_by(F.struct("day", "close", "sigma", "sigma_252"), "day").alias("b")).select("symbol", "b.*")
    b = b.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    spread = 1.2815515655446004 * F.col("sigma") * F.sqrt(F.col("horizon").cast("double"))
    return b.select("symbol", "horizon", (F.col("sigma") * F.sqrt(F.lit(252.0))).alias("sigma_year"), (F.col("sigma_252") * F.sqrt(F.lit(252.0))).alias("sigma_year_252"), (F.col("close") * F.exp(-spread)).alias("p10"), F.col("close").alias("p50"), (F.col("close") * F.exp(spread)).alias("p90"))


def engineered(bars: DataFrame) -> DataFrame:
    """Past-only features: returns 10/40, distances from means, z-score 20, percentile 60, volatility ratios, log slope 20, and the changes over five bars of the strength index and of the five-bar return."""
    close, w = F.col("close"), ordered()
    b = bars.withColumns({"r": log_return(), "y": F.log("close"), "x": F.row_number().over(w).cast("double"), "d": close - F.lag("close").over(w)})
    gains, losses = (F.avg(F.greatest(x, F.lit(0.0))).over(last_rows(14)) for x in (F.col("d"), -F.col("d")))
    simple = 100 - 100 / (1 + gains / F.when(losses == 0, 1e-9).otherwise(losses))
    b = b.withColumns({"rsi": (simple - 50) / 50, "r5": close / F.lag("close", 5).over(w) - 1})
    below = F.size(F.filter(F.collect_list("close").over(last_rows(60)), lambda v: v <= F.col("close"))) / 60.0
    sd = F.stddev_pop("close").over(last_rows(20))
    f = b.select(
        "symbol",
        "day",
        "x",
        *((close / F.lag("close", k).over(w) - 1).alias(f"return_{k}") for k in (10, 40)),
        *((close / F.avg("close").over(last_rows(n)) - 1).alias(f"sma_distance_{n}") for n in (20, 100, 200)),
        F.when(sd > 1e-12, (close - F.avg("close").over(last_rows(20))) / sd).otherwise(0.0).alias("zscore_20"),
        below.alias("percentile_60"),
        *((F.stddev_pop("r").over(last_rows(a)) / F.greatest(F.stddev_pop("r").over(last_rows(b_)), F.lit(1e-12))).alias(f"vol_{a}_over_{b_}") for a, b_ in ((5, 20), (20, 60))),
        (F.col("rsi") - F.lag("rsi", 5).over(w)).alias("rsi_slope_5"),
        (F.col("r5") - F.lag("r5", 5).over(w)).alias("momentum_acceleration"),
        (F.regr_sxy("y", "x").over(last_rows(20)) / F.regr_sxx("y", "x").over(last_rows(20))).alias("log_slope_20"),
    )
    return f.where("x > 200").drop("x")


def scaled_score(x: Column, n: int) -> Column:
    """The value over twice the deviation of its last ``n``, clipped to 1; null with fewer than 20, 0 without deviation."""
    sd = F.stddev_pop(x).over(last_rows(n))
    score = F.when(sd < 1e-12, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x / (2 * sd))))
    return F.when(F.count(x).over(last_rows(n)) >= 20, score)
