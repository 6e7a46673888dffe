"""Gates and published products: manifests, artifacts, positioning, fallbacks, paths, snapshots, slots and scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as num


def promotion_ready(manifest: Column, instrument: str = "XAUUSD_spot") -> Column:
    """Whether a manifest (JSON) allows its model's promotion: validated, point-in-time data of a spot instrument; not if anything is missing."""
    r = F.from_json(manifest, "STRUCT<provenance: STRUCT<validated: BOOLEAN, availability: STRING, macro_vintage: STRING, price_instrument: STRING>>")["provenance"]
    ready = r["validated"] & (r["availability"] == "point_in_time") & (r["macro_vintage"] == "point_in_time") & (r["price_instrument"] == instrument)
    return F.coalesce(ready, F.lit(False))


def artifact_problem(artifact: Column, features: Sequence[str]) -> Column:
    """The first thing about a model artifact (JSON) that keeps it from being loaded: ``features``, ``scaler``, ``spread`` or ``weight``; null for a good one."""
    r = F.from_json(artifact, "STRUCT<features: ARRAY<STRING>, mean: ARRAY<DOUBLE>, spread: ARRAY<DOUBLE>, weight: DOUBLE>")
    n = len(features)
    return (
        F.when(~r["features"].eqNullSafe(F.array(*map(F.lit, features))), "features")
        .when((F.size(r["mean"]) != n) | (F.size(r["spread"]) != n), "scaler")
        .when(F.exists(r["spread"], lambda x: F.isnan(x) | (x <= 0)), "spread")
        .when(~F.coalesce(r["weight"].between(0, 1), F.lit(False)), "weight")
    )


def positioning(reports: DataFrame, tie: Column, years_of_days: int = 1095) -> DataFrame:
    """(market, day, net, change, percentile, reading) of the last of weekly reports (market, day, longs, shorts, interest).

    Of a week's contracts the one of largest interest counts, then that of the
    smallest ``tie``. The percentile is the share of the last three years' nets below
    the last one: crowded from 80 on, sparse up to 20.
    """
    d = reports.groupBy("market", "day").agg(F.max_by(F.struct("longs", "shorts"), F.struct("interest", -tie)).alias("t")).select("market", "day", (F.col("t.longs") - F.col("t.shorts")).cast("long").alias("net"))
    d = d.withColumn("change", F.col("net") - F.lag("net").over(Window.partitionBy("market").orderBy("day")))
    last = d.groupBy("market").agg(F.max_by(F.struct("day", "net", "change"), "day").alias("l")).select("market", "l.*")
    past = d.select("market", F.col("day").alias("d"), F.col("net").alias("n"))
    p = last.join(past, "market").where(F.col("d") >= F.date_sub("day", years_of_days)).groupBy("market", "day", "net", "change").agg((100 * F.avg((F.col("n") < F.col("net")).cast("double"))).alias("percentile"))
    reading = F.when(F.col("percentile") >= 80, "crowded").when(F.col("percentile") <= 20, "sparse").otherwise("medium")
    return p.withColumn("reading", reading)


def fallback_artifact(bars: DataFrame) -> DataFrame:
    """What a page shows without a model: each symbol's mean and deviation, the length of its recent history, its highs, and its last day."""
    n = bars.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day"))))
    last = lambda k, x: F.when(F.col("r") <= k, x)
    return n.groupBy("symbol").agg(F.avg("close").alias("mean"), F.stddev_pop("close").alias("spread"), F.count(last(365, F.lit(1))).alias("history"), F.max(last(20, F.col("close"))).alias("high_20"), F.max(last(60, F.col("close"))).alias("high_60"), F.max("day").alias("last"))


def forecast_path(last: DataFrame, anchors: Sequence[tuple[int, float]]) -> DataFrame:
    """(symbol, day, price) for every day from a close (symbol, day, close) to the last anchor (days, return), with logarithms between anchors; the first anchor is (0, 0)."""
    days = last.select("symbol", "close", F.posexplode(F.sequence("day", F.date_add("day", anchors[-1][0]))).alias("k", "day"))
    r = F.lit(None).cast("double")
    for (a, x), (b, y) in reversed(list(zip(anchors, anchors[1:], strict=False))):
        r = F.when(F.col("k") <= b, num.path_return(F.lit(x), F.lit(y), (F.col("k") - a) / (b - a))).otherwise(r)
    return days.select("symbol", "day", (F.col("close") * (1 + r)).alias("price"))


def snapshot(stored: DataFrame, live: DataFrame, vendor: DataFrame, least: int = 10) -> DataFrame:
    """(symbol, day, price, origin, vendor, warnings): a snapshot by steps that may fail.

    ``stored`` has (symbol, day, close, n), ``live`` and ``vendor`` (symbol and a price
    of their name). Without a live quote the stored close serves; the vendor's may be
    missing; each failure and a history of under ``least`` bars is told.
    """
    s = stored.join(live, "symbol", "left").join(vendor, "symbol", "left")
    warnings = F.array_join(F.array_compact(F.array(F.when(F.col("live").isNull(), "live quote"), F.when(F.col("n") < least, "history"))), ",")
    return s.select("symbol", "day", F.coalesce("live", "close").alias("price"), F.when(F.col("live").isNull(), "stored").otherwise("live").alias("origin"), "vendor", warnings.alias("warnings"))


def slots(chosen: Column, known: Sequence[str], usual: Sequence[str], n: int = 4) -> Column:
    """``n`` slots of known, different choices in their order, filled up with the usual ones."""
    picked = F.array_distinct(F.filter(chosen, lambda x: F.array_contains(F.array(*map(F.lit, known)), x)))
    return F.slice(F.concat(picked, F.array_except(F.array(*map(F.lit, usual)), picked)), 1, n)


def put_first(taken: Column, choice: str) -> Column:
    """The slots with ``choice`` in the first, which changes places with it if it has one already."""
    return F.transform(taken, lambda x, i: F.when(i == 0, choice).when(x == choice, taken[0]).otherwise(x))


def scorecard(cards: DataFrame, confident: float = 0.2) -> DataFrame:
    """(model, horizon, mae, weight, confident, oof_rows, measured) of cards (model, card as JSON by horizon); an entry that lacks a number is left out."""
    read = F.explode(F.from_json("card", "map<string,struct<mae:double,weight:double,oof_rows:bigint>>")).alias("horizon", "m")
    rows = cards.select("model", read).select("model", F.col("horizon").try_cast("int").alias("horizon"), "m.*").where("horizon IS NOT NULL AND mae IS NOT NULL AND weight IS NOT NULL AND oof_rows IS NOT NULL")
    best = rows.groupBy("model").agg(F.max("oof_rows").alias("measured"))
    return rows.join(best, "model").select("model", "horizon", "mae", "weight", (F.col("weight") >= confident).alias("confident"), "oof_rows", "measured")
