"""Views of the stored tables as bars, observations, forecasts and headlines."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"spark-shared-{application}-")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, as in tests, a folder of its own, on a single machine only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (where or _own_dir(spark.sparkContext.applicationId)).rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint: what is read twice is computed once, and lost executors cost a re-read."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by key over four partitions a core: groups that take long for their size are not put together in one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, day, open, high, low, close, volume) from line items: a trade is a line, its price that of one unit.

    Open and close are those of the first and last trade in the order of the
    line's keys. The aggregate combines before it shuffles.
    """
    trades = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        F.to_date("l_shipdate").alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"),
        "l_quantity",
    )
    return trades.groupBy("symbol", "day").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


BARS = """bars AS (SELECT symbol, day, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(q) AS volume FROM (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS p, l_quantity AS q,
    (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) GROUP BY symbol, day)"""


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, o, h, l, c, v) from events, an hour each; v counts events."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), "event_id", "value")
    hours = events.withColumn("ts", F.date_trunc("hour", "at"))
    at = F.struct("at", "event_id")
    return hours.groupBy("symbol", "ts").agg(
        F.min_by("value", at).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", at).alias("c"), F.count("*").alias("v")
    )


HOURS = """hours AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l,
  arg_max(value, (ts, event_id)) AS c, count(*) AS v FROM events GROUP BY event_type, date_trunc('hour', ts))"""


def macro_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, obs_date, available_at, value, vintage) from orders.

    A month's first vintage averages the orders of even key and is known 15 days
    after the month began and 30 more; the revision averages all and is known a
    year later. Averages are in cents, rounded in whole numbers.
    """
    month = F.trunc("o_orderdate", "MM").alias("obs_date")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), month, cents.alias("cents"), "o_orderkey")
    sums = orders.groupBy("series", "obs_date").agg(
        F.sum(F.when(F.col("o_orderkey") % 2 == 0, F.col("cents"))).alias("s0"), F.count(F.when(F.col("o_orderkey") % 2 == 0, 1)).alias("n0"), F.sum("cents").alias("s1"), F.count("*").alias("n1")
    )
    vintages = F.explode(
        F.array(
            F.struct(F.lit("initial").alias("vintage"), F.date_add("obs_date", 45).alias("available"), F.expr("((2 * s0 + n0) div (2 * n0)) / 100D").alias("value")),
            F.struct(F.lit("revised").alias("vintage"), F.date_add("obs_date", 410).alias("available"), F.expr("((2 * s1 + n1) div (2 * n1)) / 100D").alias("value")),
        )
    ).alias("v")
    rows = sums.select("series", "obs_date", vintages).where("v.value IS NOT NULL")
    return rows.select("series", "obs_date", F.col("v.available").cast("timestamp").alias("available_at"), F.col("v.value").alias("value"), F.col("v.vintage").alias("vintage"))


MACRO = """sums AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS obs_date,
  sum(c) FILTER (WHERE o_orderkey % 2 = 0) AS s0, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS n0, sum(c) AS s1, count(*) AS n1
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) GROUP BY 1, 2),
macro AS (SELECT series, obs_date, CAST(obs_date + 45 AS TIMESTAMP) AS available_at, ((2 * s0 + n0) // (2 * n0))::DOUBLE / 100 AS value, 'initial' AS vintage FROM sums WHERE n0 > 0
  UNION ALL SELECT series, obs_date, CAST(obs_date + 410 AS TIMESTAMP), ((2 * s1 + n1) // (2 * n1))::DOUBLE / 100, 'revised' FROM sums)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, instrument, version, origin, horizon, base, p10, p50, p90, issued_at) from orders; half of the origins are issued twice."""
    o = table(spark, sf_dir, "orders")
    horizon = F.element_at(F.array(F.lit(7), F.lit(14), F.lit(30)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    base = F.col("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("instrument"),
        F.substring("o_orderpriority", 1, 1).alias("version"),
        F.to_date("o_orderdate").alias("origin"),
        horizon.alias("horizon"),
        base.alias("base"),
        (base * 0.97).alias("p10"),
        (base * (1 + (F.col("o_custkey") % 7 - 3) / 200.0)).alias("p50"),
        (base * 1.03).alias("p90"),
        (F.col("o_orderkey") % 1000).alias("issued_at"),
    )


FORECASTS = """forecasts AS (SELECT o_orderkey AS id, o_orderstatus AS instrument, substr(o_orderpriority, 1, 1) AS version, CAST(o_orderdate AS DATE) AS origin,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 14 ELSE 30 END AS INTEGER) AS horizon, o_totalprice AS base, o_totalprice * 0.97::DOUBLE AS p10,
  o_totalprice * (1 + (o_custkey % 7 - 3) / 200.0::DOUBLE) AS p50, o_totalprice * 1.03::DOUBLE AS p90, o_orderkey % 1000 AS issued_at FROM orders)"""


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, source, lang) from documents: a headline is the first 90 characters of the first line."""
    title = F.substring(F.substring_index("text", "\n", 1), 1, 90)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), title.alias("title"), "source", "lang")


HEADLINES = "headlines AS (SELECT doc_id AS id, substr(split_part(text, chr(10), 1), 1, 90) AS title, source, lang FROM documents)"
