"""Queries over headlines and other text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import dedupe
from ..sources.tables import HEADLINES, headlines, saved, table
from .registry import query

_WORDS = "list_distinct(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(translate(title, 'İI', 'iı')), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' +'), lambda w: length(w) >= 3))"


@query(f"WITH {HEADLINES} SELECT id, title, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(substr(title, 1, 60)) ORDER BY source, id) AS k FROM headlines) WHERE k = 1")
def headline_dedupe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.by_prefix(headlines(spark, sf_dir), ["source", "id"]).select("id", "title", "source")


_PAIRS = f"""{HEADLINES}, t AS (SELECT words, min(id) AS id FROM (SELECT id, list_sort({_WORDS}) AS words FROM headlines) WHERE len(words) > 0 GROUP BY words),
pairs AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.words, y.words))::DOUBLE / len(list_distinct(x.words || y.words)) AS similarity FROM t x JOIN t y ON x.id < y.id WHERE len(list_intersect(x.words, y.words)) >= 0.6 * len(list_distinct(x.words || y.words)))"""


@query(f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.jaccard_pairs(headlines(spark, sf_dir), 0.6).withColumn("similarity", F.round("similarity", 6))


@query()
def headline_near_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines that stay when each is dropped that resembles an earlier one that stays."""
    h = headlines(spark, sf_dir)
    pairs = saved(dedupe.jaccard_pairs(h, 0.6))
    linked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    firsts = h.select("id", F.array_sort(fn.word_set(F.col("title"))).alias("w")).groupBy("w").agg(F.min("id").alias("id")).select("id")
    return firsts.join(linked, "id", "left_anti").union(dedupe.keep_first(pairs, linked))


CLUSTERS = {"articles": ("the ", "das ", "les "), "verbs": ("est", "ist", "es "), "endings": ("tion", "ung", "ción")}
_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(title), '{k}')" for k in ks) + f" THEN '{c}'" for c, ks in CLUSTERS.items()) + " ELSE 'other' END"


@query(
    f"""WITH {HEADLINES}, c AS (SELECT {_CASE} AS cluster, id % 17 AS clicks, id % 17 + 20 + id % 101 AS impressions, (id % 23)::DOUBLE AS position FROM headlines)
SELECT cluster, count(*) AS n, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, round(sum(clicks)::DOUBLE / sum(impressions), 6) AS ctr, round(avg(nullif(position, 0)), 6) AS position FROM c GROUP BY cluster"""
)
def keyword_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headlines(spark, sf_dir).select(fn.first_cluster(F.col("title"), CLUSTERS).alias("cluster"), (F.col("id") % 17).alias("clicks"), (F.col("id") % 17 + 20 + F.col("id") % 101).alias("impressions"), (F.col("id") % 23).cast("double").alias("position"))
    return h.groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.round(F.sum("clicks") / F.sum("impressions"), 6).alias("ctr"), F.round(F.avg(F.nullif("position", F.lit(0.0))), 6).alias("position")
    )


@query(
    f"""WITH {HEADLINES}, o AS (SELECT id, title, id % 101 + 20 AS impressions, (id % 23)::DOUBLE AS position, (id % 3)::DOUBLE / (id % 101 + 20) AS ctr FROM headlines)
SELECT id, title, impressions, position, round(ctr, 6) AS ctr FROM o WHERE impressions >= 20 AND position BETWEEN 5 AND 20 AND ctr < 0.02 ORDER BY impressions DESC, id LIMIT 25"""
)
def top_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = headlines(spark, sf_dir).select("id", "title", (F.col("id") % 101 + 20).alias("impressions"), (F.col("id") % 23).cast("double").alias("position"), ((F.col("id") % 3) / (F.col("id") % 101 + 20)).alias("ctr"))
    o = o.where((F.col("impressions") >= 20) & F.col("position").between(5, 20) & (F.col("ctr") < 0.02))
    return o.orderBy(F.desc("impressions"), "id").limit(25).withColumn("ctr", F.round("ctr", 6))


_CENTS = "printf('%d', floor(p_retailprice)::BIGINT)"
_STYLED = "CASE p_partkey % 4 WHEN 0 THEN '1.' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || ',5' WHEN 1 THEN '1,' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '.25' WHEN 2 THEN (p_partkey % 100)::VARCHAR || ',4' ELSE '1.' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') END"


@query(
    f"""WITH s AS (SELECT p_partkey AS id, {_STYLED} AS t FROM part)
SELECT id, t AS written, CASE WHEN contains(t, '.') AND contains(t, ',') AND instr(reverse(t), ',') < instr(reverse(t), '.') THEN replace(replace(t, '.', ''), ',', '.')::DOUBLE WHEN contains(t, '.') AND contains(t, ',') THEN replace(t, ',', '')::DOUBLE
  WHEN regexp_full_match(t, '\\d{{1,3}}([.,]\\d{{3}})+') THEN regexp_replace(t, '[.,]', '', 'g')::DOUBLE ELSE replace(t, ',', '.')::DOUBLE END AS number FROM s"""
)
def locale_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pad = F.lpad((k % 1000).cast("string"), 3, "0")
    t = F.when(k % 4 == 0, F.concat(F.lit("1."), pad, F.lit(",5"))).when(k % 4 == 1, F.concat(F.lit("1,"), pad, F.lit(".25"))).when(k % 4 == 2, F.concat((k % 100).cast("string"), F.lit(",4"))).otherwise(F.concat(F.lit("1."), pad))
    s = table(spark, sf_dir, "part").select(k.alias("id"), t.alias("written"))
    return s.withColumn("number", fn.parse_number(F.col("written")))


@query(
    rf"""WITH d AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, '{fn.NUMBER}'), lambda x: replace(replace(x, '.', ''), ',', '.')::DOUBLE) AS nums,
  list_filter([n_chars::DOUBLE, doc_id::DOUBLE, n_chars / 7.0::DOUBLE, len(string_split(text, chr(10)))::DOUBLE * 100], lambda h: h IS NOT NULL AND h <> 0) AS pool FROM documents)
SELECT id, len(nums)::INTEGER AS n, len(list_filter(nums, lambda x: NOT (x <= {fn.SMALL} OR x BETWEEN {fn.YEARS[0]} AND {fn.YEARS[1]} OR x IN {fn.EXEMPT}
  OR len(list_filter(pool, lambda h: abs(x - h) <= 0.06 OR abs(x / h - 1) <= 0.006 OR abs(x - round_even(h, 0)) < 1e-9 OR abs(x - round_even(h, 1)) < 1e-9)) > 0)))::INTEGER AS unsupported FROM d"""
)
def number_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in each text that none of what is known of the document supports: its length, its number, a seventh of the length, a hundred for each line."""
    pool = F.array(F.col("n_chars").cast("double"), F.col("doc_id").cast("double"), F.col("n_chars") / 7, F.size(F.split("text", "\n")).cast("double") * 100)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), fn.locale_numbers(F.col("text")).alias("nums"), pool.alias("pool"))
    return d.select("id", F.size("nums").alias("n"), F.size(fn.unsupported_numbers(F.col("nums"), F.col("pool"))).alias("unsupported"))


@query(f"WITH {HEADLINES}, t AS (SELECT doc_id AS id, text AS t FROM documents) SELECT id, CASE WHEN length(t) <= 155 THEN t ELSE rtrim(regexp_replace(substr(t, 1, 155), '\\s\\S*$', '')) || '…' END AS short FROM t")
def truncate_at_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), fn.truncate_words(F.col("text")).alias("short"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '(yüzde\\s*)?\\d[\\d.,]*(\\s*(bin|milyon|milyar))?', '…', 'gi'), '\\s\\s+', ' ', 'g')) AS stripped FROM conversations")
def strip_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.strip_numbers(F.col("text")).alias("stripped"))


@query("SELECT page_id, length(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped, length(html) AS raw FROM pages")
def html_escape_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(fn.escape_html(F.col("html"))).cast("long").alias("escaped"), F.length("html").cast("long").alias("raw"))


@query("SELECT conv_id, role, turn, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS starts_at FROM conversations")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn starts in the joined conversation."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.sum((F.length("text") + 2).cast("long")).over(w).alias("starts_at"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha256(props) AS hash FROM events")
def json_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"), F.sha2("props", 256).alias("hash"))


@query(f"WITH {HEADLINES}, l AS (SELECT lang, id, title, row_number() OVER (PARTITION BY lang ORDER BY id DESC) AS k FROM headlines) SELECT lang, id, title, CAST(k AS INTEGER) AS k FROM l WHERE k <= 8")
def latest_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("id")))
    return headlines(spark, sf_dir).select("lang", "id", "title", k.alias("k")).where("k <= 8")


@query(f"WITH {HEADLINES}, a AS (SELECT DISTINCT lower(title) AS t FROM headlines WHERE id % 3 <> 0), b AS (SELECT DISTINCT lower(title) AS t FROM headlines WHERE id % 3 = 0) SELECT t AS title FROM a EXCEPT SELECT t FROM b")
def new_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference of one issue's headlines and the one's before."""
    h = headlines(spark, sf_dir).select("id", F.lower("title").alias("title"))
    return h.where("id % 3 <> 0").select("title").subtract(h.where("id % 3 = 0").select("title"))
