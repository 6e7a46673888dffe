"""Queries over streams, and their batch counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import HOURS, bars_hourly, shared_dir, table
from ..streaming import feeds, messages, policies
from .registry import query


@query(f"WITH {HOURS} SELECT symbol, ts, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, v FROM hours")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows are appended as the watermark passes them; those still open are taken from the stored ticks at the end."""
    closed = feeds.drained(feeds.bars(feeds.ticks(spark, sf_dir)), "append")
    edge = closed.agg(F.max("ts").alias("edge"))
    late = bars_hourly(spark, sf_dir).join(F.broadcast(edge)).where("edge IS NULL OR ts > edge")
    b = closed.unionByName(late.select(closed.columns))
    return b.withColumns({c: F.round(c, 6) for c in "ohlc"})


@query("SELECT event_id, event_type AS symbol, value FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice and is kept once."""
    twice = feeds.ticks(spark, sf_dir).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    return feeds.drained(feeds.deduplicated(twice), "append").select("event_id", "symbol", "value")


@query()
def stream_trigger_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.drained(feeds.triggers(feeds.ticks(spark, sf_dir)), "append")


@query(
    f"""WITH {HOURS}, l AS (SELECT symbol, max(ts) FILTER (WHERE hour(ts) < 18) AS p, max(ts) FILTER (WHERE hour(ts) % 2 = 1) AS f FROM hours GROUP BY symbol),
a AS (SELECT *, (epoch(TIMESTAMP '2024-01-30 20:30:00') - epoch(p)) / 60 AS age FROM l)
SELECT symbol, CASE WHEN p IS NULL AND f IS NULL THEN NULL WHEN p IS NULL OR (age > 60 AND f > p) THEN 'fallback' ELSE 'primary' END AS source, CASE WHEN p IS NULL THEN 'missing' WHEN age > 60 THEN 'stale' ELSE 'fresh' END AS reason, CAST(floor(age) AS BIGINT) AS age_minutes FROM a"""
)
def feed_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary feed ends at 18:00; the fallback has every second hour."""
    h = bars_hourly(spark, sf_dir)
    last = h.groupBy("symbol").agg(F.max(F.when(F.hour("ts") < 18, F.col("ts"))).alias("primary"), F.max(F.when(F.hour("ts") % 2 == 1, F.col("ts"))).alias("fallback"))
    return feeds.failover(last, "2024-01-30 20:30:00")


@query("SELECT event_type AS symbol, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 90")
def tick_ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 90 ticks of each symbol."""
    e = table(spark, sf_dir, "events")
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return e.withColumn("k", k).where("k <= 90").select(F.col("event_type").alias("symbol"), "event_id", "ts", "value")


@query("SELECT event_type AS symbol, max(event_id) AS event_id, max(ts) AS ts, round(arg_max(value, (ts, event_id)), 6) AS value, count(*) AS n FROM events GROUP BY event_type")
def latest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("symbol")).agg(F.max("event_id").alias("event_id"), F.max("ts").alias("ts"), F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("value"), F.count("*").alias("n"))


@query("SELECT event_type AS symbol, CAST(ts AS DATE) AS day, count(*) AS n, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END)::BIGINT AS positive, CAST(ts AS DATE) = DATE '2024-01-30' AS partial FROM events GROUP BY event_type, CAST(ts AS DATE)")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks by day; today's day is marked partial."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    g = e.groupBy(F.col("event_type").alias("symbol"), "day").agg(F.count("*").alias("n"), F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("positive"))
    return g.withColumn("partial", F.col("day") == F.lit("2024-01-30").cast("date"))


_QUOTA = policies.Quota()


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, ts, epoch_us(ts) / 1e6::DOUBLE AS sec, event_type = 'error' AS failed, event_type = 'purchase' AS forced,
  CAST(CAST(timezone('{_QUOTA.zone}', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
s AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::TIMESTAMP AS ts, '' AS decision, '' AS day, 0 AS attempts, NULL::DOUBLE AS ok, NULL::DOUBLE AS tried, NULL::DOUBLE AS rest FROM (SELECT DISTINCT key FROM e) UNION ALL
  SELECT key, n, id, ts, decision, day, CASE WHEN goes THEN used + 1 ELSE used END, CASE WHEN goes AND NOT failed THEN sec ELSE ok END, CASE WHEN goes THEN sec ELSE tried END, CASE WHEN goes AND failed THEN sec + {60 * _QUOTA.cooldown} ELSE rest END FROM (
    SELECT *, decision IN ('force', 'allowed') AS goes FROM (SELECT e.*, used, ok, tried, rest, CASE WHEN forced THEN 'force' WHEN sec < rest THEN 'rest' WHEN used >= {_QUOTA.daily} THEN 'limit' WHEN sec - ok < {60 * _QUOTA.interval} THEN 'interval' WHEN sec - tried < {60 * _QUOTA.retry} THEN 'retry' ELSE 'allowed' END AS decision
      FROM (SELECT e.*, ok, tried, rest, CASE WHEN e.day = s.day THEN s.attempts ELSE 0 END AS used FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1) e)))
SELECT key AS user_id, id AS event_id, decision, attempts::INT AS attempts FROM s WHERE n > 0"""
)
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user against a quota: an error rests, a purchase is forced. What the last hour brought still waits."""
    e = spark.readStream.schema(feeds.EVENTS).parquet(f"{sf_dir}/event[s].parquet")
    requests = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "purchase").alias("forced"))
    return feeds.drained(policies.quota_decisions(requests, _QUOTA), "append").select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "decision", "attempts")


@query("SELECT DISTINCT event_type AS symbol, ts, value FROM events")
def stream_dedup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes again under another id, and its content is kept once."""
    again = feeds.ticks(spark, sf_dir).withColumn("event_id", F.explode(F.array("event_id", -F.col("event_id") - 1)))
    once = policies.once_by_content(again, ["symbol", "ts", "value"])
    return feeds.drained(once.select("symbol", "ts", "value"), "append").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    """WITH e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS "offset", CASE event_type WHEN 'click' THEN 'ALTIN' WHEN 'view' THEN 'CEYREK_YENI' WHEN 'signup' THEN 'ATA_YENI' WHEN 'purchase' THEN 'ONS' ELSE 'USDTRY' END AS code, value, ts FROM events)
SELECT "offset", CASE WHEN code IN ('ONS', 'USDTRY') THEN 'pair' ELSE 'quote' END AS kind, code, value AS bid, value + 0.5 AS ask, CASE WHEN code NOT IN ('ONS', 'USDTRY') THEN strftime(ts, '%H:%M:%S') END AS clock FROM e"""
)
def stream_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of a price feed, stored and replayed through the source; errors come under the older code of their pair."""
    code = F.expr("CASE event_type WHEN 'click' THEN 'ALTIN' WHEN 'view' THEN 'CEYREK_YENI' WHEN 'signup' THEN 'ATA_YENI' WHEN 'purchase' THEN 'ONS' ELSE 'USD' END")
    body = F.struct(F.col("value").cast("string").alias("alis"), (F.col("value") + 0.5).alias("satis"), F.date_format("ts", "dd-MM-yyyy HH:mm:ss").alias("tarih"))
    payload = F.to_json(F.struct(F.create_map(code, body).alias("data")))
    path = f"{shared_dir(spark)}/messages-{uuid.uuid4().hex}"
    messages.store(table(spark, sf_dir, "events").select("ts", "event_id", payload.alias("payload")), path, ["ts", "event_id"])
    q = feeds.drained(messages.quotes(messages.replay(spark, path)), "append")
    return q.select("offset", "kind", "code", "bid", "ask", "clock")
