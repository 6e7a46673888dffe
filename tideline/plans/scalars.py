"""Queries over parsers, scalar functions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as fn
from ..sources import feeds
from ..sources.tables import table
from .registry import query


@query("SELECT event_type AS symbol, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(max(greatest(value, value)), 6) AS high, round(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 9 END), 6)::BIGINT AS volume FROM events WHERE event_id % 7 <> 0 GROUP BY 1, 2")
def chart_json_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed as provider charts of a day, in pages of 10,000 event numbers and with gaps in the arrays, and read again."""
    e = table(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "page": F.floor(F.col("event_id") / 10000)})
    e = e.groupBy("event_type", "day", "page").agg(F.collect_list(F.struct("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "value")).alias("x"))
    col = lambda f: F.transform("x", f)
    close = col(lambda r: F.when(r["event_id"] % 7 != 0, r["value"]))
    volume = col(lambda r: F.when(r["event_id"] % 5 != 0, r["event_id"] % 9))
    quote = F.array(F.struct(close.alias("open"), close.alias("high"), close.alias("low"), close.alias("close"), volume.alias("volume")))
    result = F.array(F.struct(col(lambda r: r["t"]).alias("timestamp"), F.struct(quote.alias("quote")).alias("indicators")))
    payloads = e.select("event_type", F.to_json(F.struct(F.struct(result.alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("payload"))
    b = feeds.chart_bars(payloads, "payload", ["event_type"]).withColumn("day", F.to_date("ts"))
    return b.groupBy(F.col("event_type").alias("symbol"), "day").agg(F.count("*").alias("n"), F.round(F.max("h"), 6).alias("high"), F.sum("v").alias("volume"))


@query("SELECT o_orderstatus AS series, CAST(o_orderdate AS DATE) AS day, o_totalprice AS value FROM orders WHERE o_orderkey % 10 <> 0")
def series_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as series lines, a tenth of them with a missing value, and read again."""
    o = table(spark, sf_dir, "orders")
    line = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 10 == 0, ".").otherwise(F.col("o_totalprice").cast("string")))
    return feeds.series_csv(o.select(F.col("o_orderstatus").alias("series"), line.alias("line")), "line", ["series"])


_LAGS = {"1-URGENT": 45, "2-HIGH": 10, "3-MEDIUM": 2, "4-NOT SPECIFIED": 2, "5-LOW": 45}


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The primary source answers with pages for two series, and the second one knows one of them."""
    o = table(spark, sf_dir, "orders")
    line = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice").cast("string"))
    broken = F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")
    answers = F.array_compact(F.array(F.struct(F.lit("primary").alias("source"), F.when(broken, "<html>error</html>").otherwise(line).alias("line")), F.when(F.col("o_orderpriority") == "5-LOW", F.struct(F.lit("second").alias("source"), line.alias("line")))))
    lines = o.select(F.col("o_orderpriority").alias("series"), F.explode(answers).alias("a")).select("series", "a.*")
    return feeds.macro_store(lines, ["primary", "second"], spark.createDataFrame(list(_LAGS.items()), "series string, lag_days int"))


@query("SELECT o_orderpriority AS series, CASE o_orderpriority WHEN '5-LOW' THEN 'second' ELSE 'primary' END AS source, CAST(o_orderdate AS DATE) AS obs_date, o_totalprice AS value, CAST(CAST(o_orderdate AS DATE) + CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN 10 WHEN '3' THEN 2 ELSE 45 END AS DATE) AS available FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'")
def macro_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir)[0].select("series", "source", "obs_date", "value", F.to_date("available_at").alias("available"))


@query("SELECT DISTINCT o_orderpriority AS series, CASE o_orderpriority WHEN '5-LOW' THEN 'primary' ELSE 'primary,second' END AS failed, CASE o_orderpriority WHEN '5-LOW' THEN 'second' END AS used FROM orders WHERE o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')")
def macro_store_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir)[1]


@query("SELECT o_custkey % 50 AS k, o_orderkey AS id FROM orders o WHERE CASE WHEN EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey % 50 = o.o_custkey % 50 AND p.o_orderstatus = 'P') THEN o_orderstatus = 'P' ELSE o_orderstatus = 'O' END")
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key has the rows of its first source only."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("source"))
    return feeds.one_source(o, ["P", "O"], ["k"]).select("k", "id")


@query("SELECT o_custkey AS customer, max(o_orderkey) AS last_order, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey".replace("max(o_orderkey)", "arg_max(o_orderkey, (o_orderdate, o_orderkey))"))
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("last_order"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return feeds.latest(o, ["customer"], F.struct("o_orderdate", "last_order")).select("customer", "last_order", "status")


@query(
    """SELECT o_orderkey AS id, year(d)::VARCHAR || CASE WHEN month(d) <= 6 THEN 'H1' ELSE 'H2' END AS half, CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) AS next_month, day(last_day(d))::INTEGER AS days,
  substr('FGHJKMNQUVXZ', month(d)::INTEGER, 1) || strftime(d, '%y') AS contract, isodow(d)::INTEGER AS weekday, weekofyear(d)::INTEGER AS week FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""
)
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    return o.select("id", fn.half_year(d).alias("half"), fn.next_month(d).alias("next_month"), fn.days_in_month(d).alias("days"), fn.contract_code(d).alias("contract"), (F.weekday(d) + 1).alias("weekday"), F.weekofyear(d).alias("week"))


@query(
    """SELECT event_id, CAST(date_trunc('day', timezone('America/Los_Angeles', timezone('UTC', ts))) AS TIMESTAMP) AS local_day, date_diff('second', ts, TIMESTAMP '2024-02-01') // 60 AS age_minutes FROM events"""
)
def quota_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    start = F.from_utc_timestamp(fn.quota_day_start(ts), "America/Los_Angeles")
    age = F.floor((F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", ts))) / 60)
    return table(spark, sf_dir, "events").select("event_id", start.alias("local_day"), age.alias("age_minutes"))


@query(
    """SELECT c_custkey AS id, round(least(100, greatest(0, 100 * (c_acctbal - 1000) / 5000)), 6) AS probability, round(c_acctbal * ((1 + (c_nationkey + 1) / 1000.0::DOUBLE) ** 12 - 1), 6) AS cost,
  round(exp(ln(1.02::DOUBLE) * (1 - c_nationkey / 25.0::DOUBLE) + ln(1.1::DOUBLE) * c_nationkey / 25.0::DOUBLE) - 1, 6) AS path FROM customer"""
)
def price_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    t = F.col("c_nationkey") / F.lit(25.0)
    return c.select(
        F.col("c_custkey").alias("id"),
        F.round(fn.implied_probability(F.col("c_acctbal"), F.lit(1000.0), F.lit(6000.0)), 6).alias("probability"),
        F.round(fn.compound_cost(F.col("c_acctbal"), (F.col("c_nationkey") + 1) / F.lit(1000.0), 12), 6).alias("cost"),
        F.round(fn.path_return(F.lit(0.02), F.lit(0.1), t), 6).alias("path"),
    )


_LAYERS = [([[0.1 * ((i * 7 + j * 3) % 5 - 2) for j in range(64)] for i in range(4)], [0.1, -0.1, 0.2, 0.0]), ([[0.5, -0.4, 0.3, 0.2]], [0.05])]


def _sql_pass() -> str:
    (w1, b1), (w2, b2) = _LAYERS
    dot = lambda x, w: f"list_sum(list_transform(list_zip({x}, [{', '.join(f'{v!r}::DOUBLE' for v in w)}]), lambda p: p[1] * p[2]))"
    hidden = ", ".join(f"tanh({dot('embedding', w)} + {b!r}::DOUBLE)" for w, b in zip(w1, b1, strict=True))
    return f"SELECT vec_id, round({dot('h', w2[0])} + {b2[0]!r}::DOUBLE, 6) AS score FROM (SELECT vec_id, [{hidden}] AS h FROM embeddings)"


@query(_sql_pass())
def forward_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", F.round(fn.forward_pass(F.col("x"), _LAYERS), 6).alias("score"))


@query("SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS mean_0, round(stddev_pop(embedding[1]::DOUBLE), 6) AS sd_0, round(avg(embedding[64]::DOUBLE), 6) AS mean_63 FROM embeddings GROUP BY label")
def vector_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(x[0]), 6).alias("mean_0"), F.round(F.stddev_pop(x[0]), 6).alias("sd_0"), F.round(F.avg(x[63]), 6).alias("mean_63"))
