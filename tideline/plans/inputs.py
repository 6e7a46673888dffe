"""Queries over provider inputs that have landed as text, their gates, and what is published from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as fn
from ..operators import bars as bar_ops
from ..operators import products
from ..operators import windows as win
from ..sources import feeds, sinks
from ..sources.tables import BARS, HOURS, MACRO, bars_daily, bars_hourly, macro_observations, saved, shared_dir, table
from .registry import query
from .windows import all_rounded, frame


@query(
    f"""WITH {HOURS}, t AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_max(c, ts) AS last, max(c) AS hi, min(c) AS lo, count(*) AS n, max(ts) AS last_ts FROM hours GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) % 3 AS k FROM t)
SELECT symbol, day, round(CASE k WHEN 0 THEN last + 1 ELSE last END, 6) AS price, last_ts AS ts, round(CASE k WHEN 0 THEN hi + 2 ELSE hi END, 6) AS high, round(lo, 6) AS low, CAST(n AS INTEGER) AS n FROM k"""
)
def live_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart payloads of each symbol and day; every third has a price and a high of its own in its head."""
    h = bars_hourly(spark, sf_dir).withColumn("day", F.to_date("ts"))
    g = h.groupBy("symbol", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "c"))), lambda x: x["c"]).alias("close"), F.max("ts").alias("at"))
    third = F.row_number().over(Window.partitionBy("symbol").orderBy("day")) % 3 == 0
    g = g.withColumn("own", third)
    meta = F.struct(F.when(F.col("own"), F.element_at("close", -1) + 1).alias("regularMarketPrice"), F.unix_timestamp("at").alias("regularMarketTime"), F.when(F.col("own"), F.array_max("close") + 2).alias("regularMarketDayHigh"))
    quote = F.struct(F.array(F.struct("close")).alias("quote"))
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(meta.alias("meta"), quote.alias("indicators"))).alias("result")).alias("chart")))
    p = g.select("symbol", "day", payload.alias("payload")).unionByName(spark.createDataFrame([("broken", None, "{")], "symbol string, day date, payload string"))
    q = feeds.live_quote(p, "payload", ["symbol", "day"])
    return q.select("symbol", "day", F.round("price", 6).alias("price"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("high", 6).alias("high"), F.round("low", 6).alias("low"), "n")


@query(f"WITH {BARS} SELECT symbol, day, round(close, 8) AS value FROM bars")
def fixing_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixing payload for each symbol and year; days that come twice keep their first entry."""
    b = bars_daily(spark, sf_dir)
    e = F.struct(F.date_format("day", "yyyy-MM-dd").alias("d"), F.array("close", F.lit(-1.0)).alias("v"))
    again = F.struct(F.date_format("day", "yyyy-MM-dd").alias("d"), F.array(F.lit(0.5)).alias("v"))
    g = b.groupBy("symbol", F.year("day").alias("year")).agg(F.to_json(F.concat(F.collect_list(e), F.collect_list(again))).alias("payload"))
    return feeds.fixings(g, "payload", ["symbol", "year"]).select("symbol", "day", F.round("value", 8).alias("value"))


@query(
    f"""WITH {MACRO}, m AS (SELECT obs_date AS day, max(value) FILTER (WHERE series LIKE '1%') AS ten, max(value) FILTER (WHERE series LIKE '2%') AS thirty FROM macro WHERE vintage = 'revised' GROUP BY obs_date)
SELECT day, ten AS value FROM m WHERE ten IS NOT NULL"""
)
def yield_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten-year column of a yield-curve file, found by its header, whichever place it has."""
    m = macro_observations(spark, sf_dir).where("vintage = 'revised'").groupBy("obs_date").agg(F.max(F.when(F.col("series").startswith("1"), F.col("value"))).alias("ten"), F.max(F.when(F.col("series").startswith("2"), F.col("value"))).alias("thirty"))
    header = 'Date,"30 Yr","10 Yr"'
    lines = m.select(F.concat_ws(",", F.date_format("obs_date", "MM/dd/yyyy"), F.coalesce(F.col("thirty").cast("string"), F.lit("")), F.coalesce(F.col("ten").cast("string"), F.lit(""))).alias("line")).union(spark.createDataFrame([(header,)], "line string"))
    c = feeds.csv_columns(lines, "line", header, {"day": ("date",), "value": ("10 yr", "10-year")}, [])
    return c.select(F.to_date("day", "MM/dd/yyyy").alias("day"), F.col("value").try_cast("double").alias("value")).where("value IS NOT NULL")


@query(
    """SELECT c_mktsegment AS query, CAST(sum(c_custkey % 50) AS DOUBLE) AS clicks, CAST(sum(c_custkey % 1000 + 1000) AS DOUBLE) AS impressions, round(avg((c_custkey % 200) / 10.0), 6) AS position FROM customer GROUP BY 1"""
)
def search_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a search export with headers in either language and numbers in its locale, summed by query."""
    k = F.col("c_custkey")
    header = "En çok yapılan sorgular,Tıklamalar,Gösterimler,Konum"
    position = F.regexp_replace(F.format_number((k % 200) / 10.0, 1), r"\.", ";")  # a decimal comma would end the field
    lines = table(spark, sf_dir, "customer").select(F.concat_ws(",", "c_mktsegment", (k % 50).cast("string"), F.regexp_replace(F.format_number(k % 1000 + 1000, 0), ",", "."), position).alias("line"))
    names = {"query": ("top queries", "En çok yapılan sorgular"), "clicks": ("clicks", "Tıklamalar"), "impressions": ("impressions", "Gösterimler"), "position": ("position", "Konum")}
    c = feeds.csv_columns(lines, "line", header, names, [])
    c = c.select("query", *(fn.parse_number(F.translate(x, ";", ",")).alias(x) for x in ("clicks", "impressions", "position")))
    return c.groupBy("query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.round(F.avg("position"), 6).alias("position"))


@query(
    f"""WITH {BARS}, b AS (SELECT symbol, day, high, low, CASE WHEN symbol = 'A' AND day = (SELECT max(day) FROM bars WHERE symbol = 'A') THEN high + 1 ELSE close END AS close FROM bars),
ok AS (SELECT symbol FROM b GROUP BY symbol HAVING bool_and(low > 0 AND low <= close AND close <= high)), best AS (SELECT symbol FROM ok WHERE symbol IN ('A', 'N', 'R') ORDER BY CASE symbol WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END LIMIT 1)
SELECT day, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, symbol AS price_source, CASE symbol WHEN 'A' THEN 'spot' WHEN 'N' THEN 'futures proxy' ELSE 'third' END AS price_instrument FROM b WHERE symbol = (SELECT symbol FROM best)"""
)
def bars_with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source has one close above its high, so all its bars are passed over."""
    b = saved(bars_daily(spark, sf_dir))
    last = b.where("symbol = 'A'").agg(F.max("day").alias("last"))
    spoiled = F.when((F.col("symbol") == "A") & (F.col("day") == F.col("last")), F.col("high") + 1).otherwise(F.col("close"))
    rows = b.join(F.broadcast(last)).select(F.col("symbol").alias("source"), "day", F.round("high", 8).alias("high"), F.round("low", 8).alias("low"), F.round(spoiled, 8).alias("close"))
    valid = bar_ops.finite_positive("low") & bar_ops.finite_positive("high") & (F.col("low") <= F.col("close")) & (F.col("close") <= F.col("high"))
    return feeds.with_provenance(rows, [("A", "spot"), ("N", "futures proxy"), ("R", "third")], valid)


@query(
    f"""WITH {BARS}, b AS (SELECT symbol, day, CASE WHEN day_of_year % 11 = 0 THEN NULL ELSE close END AS close, CASE WHEN day_of_year % 5 = 0 THEN NULL ELSE volume END AS volume, day = max(day) OVER (PARTITION BY symbol) AS partial FROM (SELECT *, dayofyear(day) AS day_of_year FROM bars))
SELECT symbol, day, round(close, 8) AS close, coalesce(volume, 0) AS volume FROM b WHERE close IS NOT NULL AND NOT partial"""
)
def complete_futures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, last = F.dayofyear("day"), F.max("day").over(Window.partitionBy("symbol"))
    b = bars_daily(spark, sf_dir).select("symbol", "day", F.when(n % 11 != 0, F.round("close", 8)).alias("close"), F.when(n % 5 != 0, F.col("volume").cast("double")).alias("volume"), (F.col("day") == last).alias("partial"))
    return feeds.complete_futures(b)


@query(
    """WITH e AS (SELECT 'event ' || o_orderkey AS name, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30' END AS clock FROM orders)
SELECT name, day, clock, lpad(((substr(clock, 1, 2)::INT + 3) % 24)::VARCHAR, 2, '0') || substr(clock, 3, 3) AS local_clock, CAST(day - DATE '1996-05-01' AS INTEGER) AS days_until, day = DATE '1996-05-01' AS today FROM e WHERE day BETWEEN DATE '1996-05-01' AND DATE '1996-05-15'"""
)
def calendar_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.concat(F.lit("event "), k.cast("string")).alias("name"), F.to_date("o_orderdate").alias("day"), F.when(k % 3 != 0, F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30"))).alias("clock"))
    return feeds.upcoming(e, F.lit("1996-05-01").cast("date"), 14)


@query(
    """WITH h AS (SELECT o_orderkey AS id, o_orderkey % 13 = 0 AS broken, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT id, broken OR day >= DATE '1997-01-01' AS headline, NOT broken AND day >= DATE '1997-01-01' AS statement FROM h WHERE broken OR day >= DATE '1997-01-01'"""
)
def recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a headline list keeps since 1997, stamps that do not parse included, and what a list of statements keeps."""
    k = F.col("o_orderkey")
    h = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 13 == 0, "yesterday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("stamp"))
    since = F.lit("1997-01-01").cast("timestamp")
    strict = feeds.recent(h, "stamp", since, False).select("id", F.lit(True).alias("s"))
    return feeds.recent(h, "stamp", since, True).join(strict, "id", "left").select("id", F.lit(True).alias("headline"), F.coalesce("s", F.lit(False)).alias("statement"))


@query(
    """WITH r AS (SELECT o_orderpriority AS market, CAST(date_trunc('week', o_orderdate) AS DATE) AS day, o_custkey % 900 AS longs, o_custkey % 700 AS shorts, o_totalprice AS interest, o_orderkey FROM orders),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, day ORDER BY interest DESC, o_orderkey) AS k FROM r) WHERE k = 1), n AS (SELECT *, longs - shorts AS net, lag(longs - shorts) OVER (PARTITION BY market ORDER BY day) AS before, max(day) OVER (PARTITION BY market) AS last FROM d),
l AS (SELECT * FROM n WHERE day = last), p AS (SELECT l.market, 100 * avg((n.net < l.net)::INT) AS percentile FROM l JOIN n ON n.market = l.market AND n.day >= l.day - 1095 GROUP BY l.market)
SELECT market, day, CAST(net AS BIGINT) AS net, CAST(net - before AS BIGINT) AS change, round(percentile, 6) AS percentile, CASE WHEN percentile >= 80 THEN 'crowded' WHEN percentile <= 20 THEN 'sparse' ELSE 'medium' END AS reading FROM l JOIN p USING (market)"""
)
def positioning_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly reports as JSON with numbers as text: of a week's contracts the one of largest interest, its net position, and its place in three years."""
    o = table(spark, sf_dir, "orders")
    text = F.to_json(F.struct(F.date_format(F.trunc("o_orderdate", "week"), "yyyy-MM-dd").alias("day"), (F.col("o_custkey") % 900).cast("string").alias("longs"), (F.col("o_custkey") % 700).cast("string").alias("shorts"), F.col("o_totalprice").cast("string").alias("interest")))
    read = F.from_json(text, "STRUCT<day: DATE, longs: STRING, shorts: STRING, interest: STRING>")
    r = o.select(F.col("o_orderpriority").alias("market"), "o_orderkey", read.alias("r")).select("market", "o_orderkey", "r.day", *(F.col(f"r.{c}").try_cast("double").alias(c) for c in ("longs", "shorts", "interest")))
    return products.positioning(r, F.col("o_orderkey")).withColumn("percentile", F.round("percentile", 6))


@query(
    """SELECT c_custkey AS id, c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS ready FROM customer"""
)
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests as JSON: a model may be promoted only with validated, point-in-time data of a spot instrument."""
    k = F.col("c_custkey")
    when = lambda c, a, b: F.when(c, a).otherwise(b)
    p = F.struct((k % 2 == 0).alias("validated"), when(k % 3 == 0, "latest", "point_in_time").alias("availability"), F.lit("point_in_time").alias("macro_vintage"), when(k % 5 == 0, "futures", "XAUUSD_spot").alias("price_instrument"))
    m = table(spark, sf_dir, "customer").select(k.alias("id"), F.to_json(F.struct(p.alias("provenance"))).alias("manifest"))
    return m.select("id", products.promotion_ready(F.col("manifest")).alias("ready"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'features' WHEN c_custkey % 5 = 0 THEN 'scaler' WHEN c_custkey % 3 = 0 THEN 'spread' WHEN c_custkey % 11 = 0 THEN 'weight' END AS problem FROM customer"""
)
def artifact_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model artifacts as JSON, and the first thing about each that keeps it from being loaded; null for a good one."""
    k = F.col("c_custkey")
    names = F.when(k % 7 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    mean = F.when(k % 5 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))
    a = table(spark, sf_dir, "customer").select(k.alias("id"), F.to_json(F.struct(names.alias("features"), mean.alias("mean"), F.array(F.lit(1.0), F.when(k % 3 == 0, 0.0).otherwise(2.0)).alias("spread"), F.when(k % 11 == 0, 1.5).otherwise(0.5).alias("weight"))).alias("artifact"))
    return a.select("id", products.artifact_problem(F.col("artifact"), ("a", "b")).alias("problem"))


@query(
    f"""WITH {BARS}, p AS (SELECT a.day, n.close / a.close AS basis FROM (SELECT * FROM bars WHERE symbol = 'A') a JOIN (SELECT * FROM bars WHERE symbol = 'N') n ON n.day = a.day)
SELECT count(*) AS n, round(median(basis), 8) AS basis FROM (SELECT * FROM p ORDER BY day DESC LIMIT 20)"""
)
def recent_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median basis of the last twenty days that both instruments have."""
    b = saved(bars_daily(spark, sf_dir))
    spot, fut = (b.where(F.col("symbol") == s).select("day", F.col("close").alias(n)) for s, n in (("A", "spot"), ("N", "futures")))
    last = bar_ops.full_outer(spot, fut).where("basis IS NOT NULL").orderBy(F.desc("day")).limit(20)
    return last.agg(F.count("*").alias("n"), F.round(F.percentile("basis", 0.5), 8).alias("basis"))


@query(
    f"""WITH {BARS}, a AS (SELECT symbol, day, close / lag(close, 5) OVER w - 1 AS p FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)), b AS (SELECT symbol, day, ln(close / lag(close, 5) OVER w) AS q FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT a.symbol, count(*) AS n, round(max(abs(p - q)), 8) AS most, round(arg_max(p - q, a.day), 8) AS last, round(avg(abs(p)) - avg(abs(q)), 8) AS gain FROM a JOIN b ON a.symbol = b.symbol AND a.day = b.day WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY a.symbol"""
)
def prediction_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of predictions side by side; both must have the same keys, else it is an error."""
    b = saved(bars_daily(spark, sf_dir))
    w = Window.partitionBy("symbol").orderBy("day")
    p = b.select("symbol", "day", (F.col("close") / F.lag("close", 5).over(w) - 1).alias("p")).where("p IS NOT NULL")
    q = b.select("symbol", "day", F.log(F.col("close") / F.lag("close", 5).over(w)).alias("q")).where("q IS NOT NULL")
    j = p.join(q, ["symbol", "day"], "full_outer")
    whole = F.assert_true(F.col("p").isNotNull() & F.col("q").isNotNull(), F.lit("the sets have different keys"))
    j = j.where(whole.isNull())
    return j.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("p") - F.col("q"))), 8).alias("most"), F.round(F.max_by(F.col("p") - F.col("q"), "day"), 8).alias("last"), F.round(F.avg(F.abs("p")) - F.avg(F.abs("q")), 8).alias("gain"))


@query("SELECT o_custkey AS run, CAST(sum(o_orderkey % 100) AS BIGINT) AS input_tokens, CAST(sum(o_orderkey % 10) AS BIGINT) AS output_tokens FROM orders GROUP BY 1")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their usage by role as a map; a run's row sums it."""
    u = F.struct(F.col("o_orderkey").cast("string").alias("role"), F.struct((F.col("o_orderkey") % 100).alias("input_tokens"), (F.col("o_orderkey") % 10).alias("output_tokens")).alias("u"))
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.map_from_entries(F.collect_list(u)).alias("usage"))
    i, o = sinks.token_sums(F.col("usage"))
    return runs.select("run", i.alias("input_tokens"), o.alias("output_tokens"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE o_totalprice END AS price, 'ölçüm' AS name FROM orders"""
)
def metric_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as JSON and read back: NaN and infinite values are null, other scripts stay as they are."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 5 == 0, float("nan")).when(k % 5 == 1, float("inf")).otherwise(F.col("o_totalprice")).alias("price"), F.lit("ölçüm").alias("name"))
    j = sinks.as_json(rows, ["id"])
    return j.select("id", F.from_json("json", "STRUCT<price: DOUBLE, name: STRING>").alias("r")).select("id", "r.price", "r.name")


@query(
    f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r FROM bars)
SELECT symbol, round(avg(close), 6) AS mean, round(stddev_pop(close), 6) AS spread, count(*) FILTER (WHERE r <= 365) AS history, round(max(close) FILTER (WHERE r <= 20), 6) AS high_20, round(max(close) FILTER (WHERE r <= 60), 6) AS high_60, max(day) AS last FROM n GROUP BY symbol"""
)
def fallback_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page shows without a model: means and deviations, the length of the recent history, and its highs."""
    return all_rounded(products.fallback_artifact(bars_daily(spark, sf_dir)))


@query(
    f"""WITH {BARS}, v AS (SELECT symbol, day, stddev_pop(r) OVER {frame(20)} AS v, count(r) OVER {frame(20)} AS n, CAST(max(day) OVER (PARTITION BY symbol) - day AS INTEGER) AS age FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS r FROM bars)),
m AS (SELECT symbol, median(v) AS usual FROM v WHERE n = 20 GROUP BY symbol)
SELECT symbol, day, round(least(greatest(v / greatest(usual, 1e-9), 0.75), 2.0), 6) AS scale, round(exp(-ln(2) * age / 365.0), 6) AS weight FROM v JOIN m USING (symbol) WHERE n = 20"""
)
def scale_and_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility against the symbol's usual one, within 0.75 and 2, and weights that halve in a year."""
    b = bars_daily(spark, sf_dir).withColumn("r", win.log_return())
    age = F.datediff(F.max("day").over(Window.partitionBy("symbol")), "day")
    v = saved(b.select("symbol", "day", F.stddev_pop("r").over(win.last_rows(20)).alias("v"), F.count("r").over(win.last_rows(20)).alias("n"), age.alias("age")).where("n = 20"))
    m = v.groupBy("symbol").agg(F.percentile("v", 0.5).alias("usual"))
    return v.join(m, "symbol").select("symbol", "day", F.round(num.volatility_scale(F.col("v"), F.col("usual")), 6).alias("scale"), F.round(num.recency_weight(F.col("age"), 365.0), 6).alias("weight"))


@query(
    f"""WITH {BARS}, l AS (SELECT symbol, max(day) AS day, arg_max(close, day) AS close FROM bars GROUP BY symbol), s AS (SELECT symbol, close, CAST(unnest(generate_series(day, day + 30, INTERVAL 1 DAY)) AS DATE) AS day, day AS start FROM l),
t AS (SELECT *, CAST(day - start AS INTEGER) AS k FROM s)
SELECT symbol, day, round(close * (1 + exp(CASE WHEN k <= 7 THEN ln(1.01) * k / 7 WHEN k <= 14 THEN ln(1.01) + (ln(1.03) - ln(1.01)) * (k - 7) / 7 ELSE ln(1.03) + (ln(0.98) - ln(1.03)) * (k - 14) / 16 END) - 1), 6) AS price FROM t"""
)
def forecast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price for every day up to the last horizon: returns of 1, 3 and -2 % after 7, 14 and 30 days, with logarithms between."""
    last = bars_daily(spark, sf_dir).groupBy("symbol").agg(F.max_by(F.struct("day", "close"), "day").alias("l")).select("symbol", "l.*")
    return products.forecast_path(last, [(0, 0.0), (7, 0.01), (14, 0.03), (30, -0.02)]).withColumn("price", F.round("price", 6))


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_custkey AS job, count(*) AS runs, max(day) AS last_run, count(*) FILTER (WHERE day >= DATE '1998-01-01') AS recent FROM o GROUP BY 1"""
)
def rebuilt_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's state after a cold start: what its published runs say, read from the files they were written to."""
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 2 == 0).alias("ok")).write.csv(path, header=True)
    runs = sinks.reload_csv(spark, path, "job long, day date, ok boolean")
    return runs.groupBy("job").agg(F.count("*").alias("runs"), F.max("day").alias("last_run"), F.count_if(F.col("day") >= "1998-01-01").alias("recent"))


@query(
    f"""WITH {BARS}, l AS (SELECT symbol, max(day) AS day, arg_max(close, day) AS close, count(*) AS n FROM bars GROUP BY symbol)
SELECT symbol, day, round(close, 6) AS price, CASE WHEN symbol = 'R' THEN 'stored' ELSE 'live' END AS origin, CASE WHEN symbol = 'R' THEN NULL ELSE round(close + 1, 6) END AS vendor, array_to_string(list_filter([CASE WHEN symbol = 'R' THEN 'live quote' END, CASE WHEN n < 10 THEN 'history' END], lambda x: x IS NOT NULL), ',') AS warnings FROM l"""
)
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of each symbol by steps that may fail: without a live quote the stored close serves, an optional vendor may be missing, and each failure is told."""
    b = saved(bars_daily(spark, sf_dir))
    last = b.groupBy("symbol").agg(F.max_by(F.struct("day", "close"), "day").alias("l"), F.count("*").alias("n")).select("symbol", "l.*", "n")
    live = last.where("symbol != 'R'").select("symbol", F.col("close").alias("live"))
    vendor = last.where("symbol != 'R'").select("symbol", (F.col("close") + 1).alias("vendor"))
    return all_rounded(products.snapshot(last, live, vendor))
