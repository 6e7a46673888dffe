"""Feature and label tables, and the gates that guard them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import matured_so_far
from . import asof
from .windows import gold_features, ordered

GOLD = ("return_1", "return_5", "return_20", "ma50_distance", "rsi14", "atr14", "volatility_20", "drawdown_60")


def feature_table(bars: DataFrame, macro: DataFrame, horizons: tuple[int, ...] = (7, 14, 30)) -> DataFrame:
    """Bar features, macro values and 90-day changes as of each day, and forward returns.

    Bar windows count bars, macro look-backs calendar days. Days that lack any
    feature are left out; the tail without labels stays. ``macro`` is (series,
    day, value); each of its series becomes two columns, a level and a change.
    """
    out = gold_features(bars)
    days = bars.select("day").distinct()
    names = [r.series for r in macro.select("series").distinct().orderBy("series").collect()]
    probes = days.withColumn("series", F.explode(F.array(*map(F.lit, names))))
    ch = asof.change(probes, macro, ["series"], "day", "value", 90)
    wide = ch.groupBy("day").pivot("series", names).agg(F.first("value").alias("level"), F.first("ratio").alias("change"))
    wide = wide.toDF("day", *(c.lower().replace("-", "_").replace(" ", "_").replace(".", "") for c in wide.columns[1:]))
    labels = asof.forward_return(bars, horizons).groupBy("symbol", "day").pivot("horizon", list(horizons)).agg(F.first("target_return"))
    labels = labels.toDF("symbol", "day", *(f"target_{h}d" for h in horizons))
    joined = out.join(wide, "day").join(labels, ["symbol", "day"], "left")
    return joined.dropna(subset=[c for c in joined.columns if c not in ("symbol", "day") and not c.startswith("target")])


def frozen(rows: DataFrame, columns: list[str], n: int = 16) -> DataFrame:
    """(symbol, feature, frozen): whether the last ``n`` rows of a symbol all hold one same value; with a null or fewer rows, not."""
    r = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))
    last = rows.withColumn("r", r).where(F.col("r") <= n)
    long = last.select("symbol", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns))).alias("f"))
    g = long.groupBy("symbol", "f.feature").agg(F.count("f.value").alias("known"), F.min("f.value").alias("lo"), F.max("f.value").alias("hi"))
    return g.select("symbol", "feature", ((F.col("known") == n) & (F.col("lo") == F.col("hi"))).alias("frozen"))


def freshness(observations: DataFrame, required: DataFrame, as_of: Column, stale_days: int = 7) -> DataFrame:
    """(series, rows, last, age_days, state) of each required series: OK, STALE_DATA, INSUFFICIENT_DATA, or FUTURE_DATA."""
    o = observations.groupBy("series").agg(F.count("*").alias("rows"), F.max("obs_date").alias("last"))
    j = required.select("series").distinct().join(o, "series", "left")
    age = F.datediff(as_of, "last")
    state = F.when(F.col("last").isNull(), "INSUFFICIENT_DATA").when(age < 0, "FUTURE_DATA").when(age > stale_days, "STALE_DATA").otherwise("OK")
    return j.select("series", F.coalesce("rows", F.lit(0)).alias("rows"), "last", age.alias("age_days"), state.alias("state"))


def date_order(rows: DataFrame, position: str) -> DataFrame:
    """Rows whose day does not come after the day before them in file order."""
    w = Window.partitionBy("symbol").orderBy(position)
    return rows.withColumn("before", F.lag("day").over(w)).where("day <= before")


def missing_names(rows: DataFrame, columns: list[str]) -> Column:
    """Names of the null or non-finite columns, in order."""
    bad = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(c)) for c in columns]
    return F.array_compact(F.array(*bad))


def wrapped_sum(c: Column) -> Column:
    """A sum of whole numbers modulo 2^64 as a signed long: their sum where that fits, and no overflow where it does not."""
    whole, half = (F.expr(f"CAST('{2**n}' AS DECIMAL(20,0))") for n in (64, 63))
    left = F.pmod(F.sum(c.cast("decimal(20,0)")), whole)
    return F.when(left < half, left).otherwise(left - whole).cast("long")


def manifest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row count, and a hash of all rows that does not depend on their order (a sum modulo 2^64), for each of ``keys``."""
    line = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rows.columns)), 256)
    part = F.conv(F.substring(line, 1, 12), 16, 10).cast("long")
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), wrapped_sum(part).alias("checksum"))


def fold_rows(rows: DataFrame, folds: tuple[float, ...] = (0.55, 0.70, 0.85), calibration: float = 0.2, least: int = 30, keep: Sequence[str] = ()) -> DataFrame:
    """(symbol, horizon, fold, day, target_day, part, and the columns ``keep``): the rows of purged expanding folds of labelled rows.

    A fold's test rows start at a share of the rows. What is trained on has a
    target that matured before the test starts; the last part of the training
    rows is for calibration, and rows whose target matures in it are purged.
    """
    w = Window.partitionBy("symbol", "horizon")
    kept = [F.struct(*keep).alias("_kept")] if keep else []  # apart from the names used here
    r = rows.where("target_day IS NOT NULL").select("symbol", "horizon", "day", "target_day", *kept).withColumns({"i": F.row_number().over(w.orderBy("day")) - 1, "n": F.count("*").over(w)})
    bounds = F.explode(F.array(*(F.struct(F.lit(k).alias("fold"), F.floor(F.col("n") * a).alias("start"), (F.floor(F.col("n") * b) if b < 1 else F.col("n")).alias("stop")) for k, (a, b) in enumerate(zip(folds, (*folds[1:], 1.0), strict=True)))))
    f = r.withColumn("b", bounds).select("symbol", "horizon", "day", "target_day", "i", "b.*", *(["_kept"] if keep else []))
    g = Window.partitionBy("symbol", "horizon", "fold")
    f = f.withColumn("test_day", F.min(F.when(F.col("i") == F.col("start"), F.col("day"))).over(g))
    f = f.withColumn("usable", (F.col("i") < F.col("start")) & (F.col("target_day") < F.col("test_day")))
    f = f.withColumns({"m": F.sum(F.col("usable").cast("int")).over(g), "k": F.sum(F.col("usable").cast("int")).over(g.orderBy("day"))})
    f = f.withColumn("tail", F.greatest(F.lit(least), F.floor(F.col("m") * calibration).cast("int")))
    f = f.withColumn("in_tail", F.col("usable") & (F.col("k") > F.col("m") - F.col("tail")))
    f = f.withColumn("tail_day", F.min(F.when(F.col("in_tail"), F.col("day"))).over(g))
    part = F.when((F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop")), "test").when(F.col("in_tail"), "calibrate").when(F.col("usable") & (F.col("target_day") < F.col("tail_day")), "train").when(F.col("i") < F.col("start"), "purged")
    return f.withColumn("part", part).where("part IS NOT NULL").select("symbol", "horizon", "fold", "day", "target_day", "part", *(F.col("_kept")[c].alias(c) for c in keep))


def walk_forward(rows: DataFrame, folds: tuple[float, ...] = (0.55, 0.70, 0.85), calibration: float = 0.2, least: int = 30) -> DataFrame:
    """(fold, symbol, horizon, part, n, first, last) of ``fold_rows``."""
    f = fold_rows(rows, folds, calibration, least)
    return f.groupBy("symbol", "horizon", "fold", "part").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def calibration_split(rows: DataFrame, share: float = 0.6, least: int = 10) -> DataFrame:
    """(symbol, horizon, fold, day, use): calibration rows of ``fold_rows`` for the weight, and later ones for the interval.

    Rows for the weight have targets that matured before the first row for the
    interval. A fold with fewer than ``least`` of either has none.
    """
    w = Window.partitionBy("symbol", "horizon", "fold")
    c = rows.where("part = 'calibrate'").withColumns({"i": F.row_number().over(w.orderBy("day")), "n": F.count("*").over(w)})
    c = c.withColumn("late", F.col("i") > F.greatest(F.lit(1), F.floor(F.col("n") * share)))
    c = c.withColumn("first", F.min(F.when(F.col("late"), F.col("day"))).over(w))
    c = c.withColumn("use", F.when(F.col("late"), "interval").when(F.col("target_day") < F.col("first"), "weight")).where("use IS NOT NULL")
    c = c.withColumns({"a": F.count_if(F.col("use") == "weight").over(w), "b": F.count_if(F.col("use") == "interval").over(w)})
    return c.where((F.col("a") >= least) & (F.col("b") >= least)).select("symbol", "horizon", "fold", "day", "use")


def imputed(rows: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Unknown values of ``columns`` become the median of the symbol's training rows, or 0 if these know none."""
    m = rows.where(train).groupBy("symbol").agg(*(F.percentile(F.when(~F.isnan(c), F.col(c)), 0.5).alias(f"m_{c}") for c in columns))
    j = rows.join(m, "symbol", "left")
    return j.withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.col(f"m_{c}"), F.lit(0.0)) for c in columns}).select(*rows.columns)


def latest_vector(rows: DataFrame, columns: Sequence[str], frozen_rows: DataFrame) -> DataFrame:
    """(symbol, day, price, fingerprint, frozen) of each symbol's last row: a hash of its features in millionths, and the features that stand still."""
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("day", "close", *columns), "day").alias("r")).select("symbol", "r.*")
    line = F.concat_ws(",", *(F.round(F.col(c) * 1e6).cast("long").cast("string") for c in columns))
    still = frozen_rows.where("frozen").groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("frozen"))
    return last.join(still, "symbol", "left").select("symbol", "day", F.col("close").alias("price"), F.sha2(line, 256).alias("fingerprint"), F.coalesce("frozen", F.lit("")).alias("frozen"))


def rolling_baselines(labels: DataFrame, last: int = 126) -> DataFrame:
    """For each row, of the targets that had matured before its day: their mean, the mean of the last ``last`` by maturity, and the majority's direction (up, if half are) with the median size.

    Targets of a symbol and horizon mature in the order of their days, so what has
    matured is a prefix of the targets sorted by maturity: running sums and, by two
    heaps, running medians as of the day before, found by a backward as-of join.
    """
    key = ["symbol", "horizon"]
    known = labels.where("target_day IS NOT NULL AND target_return IS NOT NULL").select(*key, "day", "target_day", "target_return")
    schema = f"symbol {labels.schema['symbol'].dataType.simpleString()}, horizon {labels.schema['horizon'].dataType.simpleString()}, at date, mean double, rolling double, majority double"
    run = known.groupBy(*key).applyInPandas(lambda rows: matured_so_far(rows, last), schema)
    run = run.select(*key, "at", F.struct("mean", "rolling", "majority").alias("s"))
    probes = labels.select(*key, F.date_sub("day", 1).alias("at"))
    hit = asof.backward(probes, run, key, "at", "s")
    return labels.select(*key, "day", F.date_sub("day", 1).alias("at")).join(hit, [*key, "at"], "left").select(*key, "day", "s.mean", "s.rolling", "s.majority")


def momentum_labels(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "day", (F.col("close") / F.lag("close", 28).over(ordered()) - 1).alias("momentum"))
