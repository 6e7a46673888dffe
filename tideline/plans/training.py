"""Queries that train forecasters, publish them and serve the champion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof
from ..operators import training as ops
from ..operators.features import GOLD
from ..operators.windows import gold_features
from ..sources.publication import Releases
from ..sources.tables import bars_daily, saved, shared_dir
from .registry import query
from .windows import all_rounded

REVISION = 1


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = saved(bars_daily(spark, sf_dir))
    labels = asof.forward_return(b).withColumnRenamed("target_return", "actual")
    return labels.join(gold_features(b).withColumnRenamed("close", "price"), ["symbol", "day"])


def champion(spark: SparkSession, sf_dir: str) -> tuple[Releases, DataFrame]:
    """Releases trained on the tables, with a champion, and the rows they were trained on; what has been trained on the same rows is kept."""
    rows = saved(_rows(spark, sf_dir))
    data = ops.fingerprint(rows)
    releases = Releases(spark, f"{shared_dir(spark)}/models-{REVISION}-{data}")
    if ops.train_decision(releases, data, 0) != "same data":
        ops.publish(ops.train(rows, GOLD, "volatility_20"), releases, "candidate-1", {"data": data})
    if releases.state()["champion"] is None:
        releases.promote("candidate-1")  # the first one has none to beat
    return releases, rows


@query()
def trained_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The champion's rows: their state, training rows, weight, widths, and the scores of the folds' test rows."""
    releases, _ = champion(spark, sf_dir)
    a = releases.read(releases.state()["champion"])
    widths = [F.col("errors")[i].alias(f"error_{round(100 * q)}") for i, q in enumerate(ops.QUANTILES)]
    return all_rounded(a.select("symbol", "horizon", "state", "training_rows", "training_end", "target_end", "tested_rows", "weight", *widths, "usual_volatility", "latest", "metrics.*"))


@query()
def champion_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored champion serves for every day of every symbol."""
    releases, rows = champion(spark, sf_dir)
    days = rows.where("horizon = 7").select("symbol", "day", "price", *GOLD)
    s = ops.serve(ops.load(releases, GOLD), days, GOLD)
    return all_rounded(s.withColumn("clipped", F.array_join("clipped", ",")).drop("effects", "version"))


@query()
def champion_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each column adds to the champion's forecasts, on average over a symbol's days: its size and its sign."""
    releases, rows = champion(spark, sf_dir)
    days = rows.where("horizon = 7").select("symbol", "day", "price", *GOLD)
    e = ops.serve(ops.load(releases, GOLD), days, GOLD).select("symbol", "horizon", F.explode("effects").alias("feature", "effect"))
    return all_rounded(e.groupBy("symbol", "horizon", "feature").agg(F.avg(F.abs("effect")).alias("size"), F.avg("effect").alias("effect")))
