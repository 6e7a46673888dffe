"""Queries that audit written reports: forbidden terms, prices, sections, budgets, names, and JSON in noisy replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as fn
from ..operators import products
from ..sources.tables import table
from .registry import query

#: Fixed value: what a report may not say.
FORBIDDEN = ("ATR", "SMA", "EMA", "RSI", "MACD", "ADX", "VIX", "DXY", "Dow", "FOMC", "Fed", "TIPS", "COT", "GVZ", "PAXG", "LBMA")
#: Fixed value: not bounded by word marks.
LOOSE = ("GC=F",)
_TERMS = "\\\\b(?:" + "|".join(FORBIDDEN) + ")\\\\b|GC=F"
ORDER = ("intro", "why", "desk", "levels", "picture", "voices", "calendar", "close")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "source", "lang", "n_chars")


@query(
    "WITH d AS (SELECT doc_id AS id, coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' the Fed, the RSI and Dowding; Fed' WHEN 1 THEN ' xGC=Fx FedWatch' ELSE '' END AS text FROM documents)\n"
    + "SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '" + _TERMS.replace("\\\\", "\\") + "'))), ',') AS terms FROM d WHERE len(regexp_extract_all(text, '" + _TERMS.replace("\\\\", "\\") + "')) > 0"
)
def forbidden_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words only: a longer word that holds a term is none; to some documents, sentences with terms are added."""
    extra = F.when(F.col("id") % 5 == 0, " the Fed, the RSI and Dowding; Fed").when(F.col("id") % 5 == 1, " xGC=Fx FedWatch").otherwise("")
    d = _documents(spark, sf_dir).withColumn("terms", fn.forbidden_terms(F.concat("text", extra), FORBIDDEN, LOOSE))
    return d.where("size(terms) > 0").select("id", F.array_join("terms", ",").alias("terms"))


_FORM = "translate(format('{{:,.{0}f}}', {1}), ',.', '.,')"


@query(
    f"""WITH p AS (SELECT o_orderkey AS id, o_totalprice AS price, 'paid ' || CASE o_orderkey % 4 WHEN 0 THEN {_FORM.format(2, "o_totalprice")} WHEN 1 THEN {_FORM.format(0, "o_totalprice")} WHEN 2 THEN {_FORM.format(1, "o_totalprice")} ELSE 'nothing' END || ' in all' AS t FROM orders)
SELECT id, contains(t, {_FORM.format(2, "price")}) OR contains(t, regexp_replace({_FORM.format(1, "price")}, ',0$', '')) OR contains(t, {_FORM.format(0, "price")}) AS mentioned FROM p"""
)
def price_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, k = F.col("o_totalprice"), F.col("o_orderkey") % 4
    t = F.concat(F.lit("paid "), F.when(k == 0, fn.grouped(price, 2)).when(k == 1, fn.grouped(price, 0)).when(k == 2, fn.grouped(price, 1)).otherwise("nothing"), F.lit(" in all"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fn.mentions_price(t, price).alias("mentioned"))


@query(
    """SELECT doc_id AS id, 'role ' || source || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '## Rules' || chr(10) || 'keep ' || doc_id ELSE '## Rules' || chr(10) || 'keep' END AS kept FROM documents WHERE source IS NOT NULL"""
)
def kept_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with front matter and sections that are skipped."""
    rules = F.when(F.col("id") % 2 == 0, F.concat(F.lit("keep "), F.col("id").cast("string"))).otherwise("keep")
    t = F.concat(F.lit("---\nname: x\n---\nrole "), F.col("source"), F.lit("\n## Inputs\nfiles\n## Rules\n"), rules, F.lit("\n## Steps\none\n## Steps again\ntwo\n"))
    return _documents(spark, sf_dir).where("source IS NOT NULL").select("id", fn.without_sections(t, ("Inputs", "Steps")).alias("kept"))


@query(
    r"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM documents)
SELECT id, len(w)::INTEGER AS words, len(w) < 200 * 0.7 AS short, array_to_string(w[1:12], ' ') AS claim, CASE WHEN length(t) <= 180 THEN t ELSE substr(t, 1, 180) || ' …' END AS cut FROM d"""
)
def word_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text, whether they are far under a budget of 200, its first twelve words, and the text cut at 180 characters."""
    t = F.col("text")
    return _documents(spark, sf_dir).select("id", fn.word_count(t).alias("words"), (fn.word_count(t) < 200 * 0.7).alias("short"), fn.first_words(t, 12).alias("claim"), fn.truncate_chars(t, 180).alias("cut"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'tracks spot' WHEN 1 THEN 'futures' WHEN 2 THEN 'official fix' ELSE s_name END AS plain FROM supplier")
def plain_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, "exchange PaxG-USD").when(k == 1, "gc=f chart").when(k == 2, "LBMA pm").otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), fn.plain_name(raw, {"PAXG": "tracks spot", "GC=F": "futures", "LBMA": "official fix"}).alias("plain"))


@query(
    f"""SELECT o_orderkey AS id, {_FORM.format(2, "o_totalprice")} AS money, CASE WHEN o_custkey % 7 - 3 > 0 THEN '+' ELSE '' END || {_FORM.format(1, "(o_custkey % 7 - 3) / 2.0::DOUBLE")} || ' %' AS move, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders"""
)
def locale_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("o_custkey") % 7 - 3) / 2.0
    move = F.concat(F.when(x > 0, "+").otherwise(""), fn.grouped(x, 1), F.lit(" %"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fn.grouped(F.col("o_totalprice"), 2).alias("money"), move.alias("move"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"))


_NAMES = ("Brown", "Garcia", "Supplier#000000003", "Supplier#000000011")


@query("SELECT s_suppkey AS id, array_to_string(list_filter(['" + "', '".join(_NAMES) + "'], lambda n: contains(s_name || ' says', n)), ',') AS names FROM supplier")
def attributed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array_join(fn.named_in(F.concat("s_name", F.lit(" says")), _NAMES), ",").alias("names"))


_IDS = "list_filter(['close', CASE WHEN c_custkey % 2 = 0 THEN 'why' END, CASE WHEN c_custkey % 3 = 0 THEN 'intro' END, 'desk', CASE WHEN c_custkey % 5 = 0 THEN 'desk' END, CASE WHEN c_custkey % 7 = 0 THEN 'other' END], lambda x: x IS NOT NULL)"
_ORDER = "['" + "', '".join(ORDER) + "']"


@query(
    f"""WITH s AS (SELECT c_custkey AS id, {_IDS} AS ids FROM customer)
SELECT id, array_to_string(list_filter(list_filter({_ORDER}, lambda x: x <> 'voices'), lambda x: NOT list_contains(ids, x)), ',') AS missing, array_to_string(list_distinct(list_filter(ids, lambda x: NOT list_contains({_ORDER}, x))), ',') AS unknown,
  array_to_string(list_sort(list_distinct(list_filter(ids, lambda x: len(list_filter(ids, lambda y: y = x)) > 1))), ',') AS twice, array_to_string(list_transform(list_sort(list_transform(ids, lambda x: {{p: coalesce(list_position({_ORDER}, x), {len(ORDER) + 1}), x: x}})), lambda s: s.x), ',') AS sorted FROM s"""
)
def section_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose sections are missing, unknown or double, and their sections in the fixed order."""
    k = F.col("c_custkey")
    ids = F.array_compact(F.array(F.lit("close"), F.when(k % 2 == 0, "why"), F.when(k % 3 == 0, "intro"), F.lit("desk"), F.when(k % 5 == 0, "desk"), F.when(k % 7 == 0, "other")))
    s = table(spark, sf_dir, "customer").select(k.alias("id"), ids.alias("ids"))
    missing, unknown, twice = fn.section_problems(F.col("ids"), ORDER, ("voices",))
    told = {"missing": missing, "unknown": unknown, "twice": twice, "sorted": fn.in_order(F.col("ids"), ORDER)}
    return s.select("id", *(F.array_join(c, ",").alias(k) for k, c in told.items()))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE c_mktsegment END AS segment FROM customer""")
def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in code fences, with words around them, bare, and broken; the alias of a key counts too."""
    k = F.col("c_custkey") % 4
    own = F.to_json(F.struct(F.col("c_mktsegment").alias("segment")))
    other = F.to_json(F.struct(F.col("c_mktsegment").alias("Segment name")))
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), own, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), other, F.lit(" as asked."))).when(k == 2, own).otherwise(F.concat(F.lit("no {object"), F.col("c_mktsegment")))
    j = fn.json_within(reply)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.coalesce(F.get_json_object(j, "$.segment"), F.get_json_object(j, "$['Segment name']")).alias("segment"))


@query(
    """WITH s AS (SELECT doc_id AS id, trim(coalesce(source, '')) AS a, trim(coalesce(lang, '')) AS b, trim(substr(coalesce(text, ''), 1, 40)) AS c FROM documents),
p AS (SELECT id, list_filter([a, b, c], lambda x: length(x) > 0) AS ps FROM s), u AS (SELECT id, unnest(ps) AS text, unnest(range(len(ps))) AS i, ps FROM p),
v AS (SELECT id, i, text, CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x) + 2)), 0) AS INTEGER) AS start FROM u), w AS (SELECT *, start + length(text) AS stop, max(start + length(text)) OVER (PARTITION BY id) AS total FROM v)
SELECT id, CAST(i AS INTEGER) AS i, start, CAST(stop AS INTEGER) AS stop, round(60.0 * start / total, 4) AS begins, round(60.0 * stop / total, 4) AS ends FROM w"""
)
def narration_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a narration of one minute, timed by their share of the characters."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), fn.segments([F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 40)]).alias("s"))
    d = d.withColumn("total", F.element_at("s", -1)["stop"]).select("id", "total", F.explode("s").alias("s")).select("id", "s.*", "total")
    return d.select("id", "i", "start", "stop", F.round(60.0 * F.col("start") / F.col("total"), 4).alias("begins"), F.round(60.0 * F.col("stop") / F.col("total"), 4).alias("ends"))


@query("SELECT page_id, replace(html, '<', chr(92) || 'u003c') AS safe FROM pages")
def json_for_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.escape_json_html(F.col("html")).alias("safe"))


@query("SELECT doc_id AS id, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def article_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of articles: their fields without the body, which the scan does not read."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


_SLOTS = ("gold", "silver", "euro", "dollar")
_S = "['" + "', '".join(_SLOTS) + "']"


@query(
    f"""WITH r AS (SELECT c_custkey AS id, [CASE c_custkey % 3 WHEN 0 THEN 'euro' WHEN 1 THEN 'bitcoin' ELSE 'silver' END, 'silver', CASE WHEN c_custkey % 2 = 0 THEN 'nonsense' ELSE 'dollar' END] AS raw FROM customer),
p AS (SELECT id, list_filter(raw, lambda x: list_contains({_S} || ['bitcoin'], x)) AS k FROM r), q AS (SELECT id, list_filter(k, lambda x, i: list_position(k, x) = i) AS u FROM p),
n AS (SELECT id, (u || list_filter({_S}, lambda x: NOT list_contains(u, x)))[1:4] AS slots FROM q)
SELECT id, array_to_string(slots, ',') AS slots, array_to_string(list_transform(slots, lambda x, i: CASE WHEN i = 1 THEN 'euro' WHEN x = 'euro' THEN slots[1] ELSE x END), ',') AS swapped FROM n"""
)
def ticker_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four slots of known, different choices, filled up with the usual ones; then euro is put first, changing places if it has one."""
    k = F.col("c_custkey")
    raw = F.array(F.when(k % 3 == 0, "euro").when(k % 3 == 1, "bitcoin").otherwise("silver"), F.lit("silver"), F.when(k % 2 == 0, "nonsense").otherwise("dollar"))
    s = table(spark, sf_dir, "customer").select(k.alias("id"), products.slots(raw, (*_SLOTS, "bitcoin"), _SLOTS).alias("slots"))
    return s.withColumn("swapped", products.put_first(F.col("slots"), "euro")).select("id", *(F.array_join(c, ",").alias(c) for c in ("slots", "swapped")))


@query(
    """WITH m AS (SELECT o_orderstatus AS model, CASE o_orderkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 14 ELSE 30 END AS horizon, avg(o_totalprice) / 1e6 AS mae, (avg(o_custkey) % 10) / 20 AS weight, count(*) AS oof FROM orders GROUP BY 1, 2)
SELECT model, CAST(horizon AS INTEGER) AS horizon, round(mae, 6) AS mae, round(weight, 6) AS weight, weight >= 0.2 AS confident, oof AS oof_rows, max(oof) OVER (PARTITION BY model) AS measured FROM m WHERE NOT (model = 'P' AND horizon = 14)"""
)
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of models, written as JSON by horizon and read back; an entry without an error is left out."""
    o = table(spark, sf_dir, "orders")
    h = F.element_at(F.array(F.lit(7), F.lit(14), F.lit(30)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    m = o.groupBy(F.col("o_orderstatus").alias("model"), h.alias("horizon")).agg((F.avg("o_totalprice") / 1e6).alias("mae"), ((F.avg("o_custkey") % 10) / 20).alias("weight"), F.count("*").alias("oof_rows"))
    m = m.withColumn("mae", F.when(~((F.col("model") == "P") & (F.col("horizon") == 14)), F.col("mae")))
    cards = m.groupBy("model").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("horizon").cast("string"), F.struct("mae", "weight", "oof_rows"))))).alias("card"))
    return products.scorecard(cards).withColumns({"mae": F.round("mae", 6), "weight": F.round("weight", 6)})


@query(
    """WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y%m%dT') || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || '0122Z' ELSE 'v' || o_orderkey END AS version, o_orderdate FROM orders),
v AS (SELECT id, CASE WHEN id % 4 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours((id % 24)::BIGINT) + INTERVAL 82 SECOND END AS made, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS seen FROM b)
SELECT id, made, strftime(made + INTERVAL 3 HOUR, '%H:%M') AS clock, CASE WHEN made IS NULL THEN false WHEN id % 9 = 0 THEN true ELSE made > seen END AS unread FROM v"""
)
def version_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact version stamps, broken ones among them: their time, the clock three hours east, and whether the version is unread."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    stamp = F.when(k % 4 != 0, F.concat(F.date_format(day, "yyyyMMdd"), F.lit("T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit("0122Z"))).otherwise(F.concat(F.lit("v"), k.cast("string")))
    v = table(spark, sf_dir, "orders").select(k.alias("id"), num.version_time(stamp).alias("made"), F.when(k % 9 != 0, day.cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("seen"))
    return v.select("id", "made", num.shifted_clock(F.col("made")).alias("clock"), num.unread(F.col("made"), F.col("seen")).alias("unread"))


@query(
    """WITH q AS (SELECT p_partkey AS id, p_retailprice * 2 AS ounce, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size / 2.0::DOUBLE END AS rate, p_retailprice * p_size / 28 AS ask, p_retailprice * p_size / 29 AS bid FROM part),
r AS (SELECT *, CASE WHEN ounce > 0 AND rate > 0 THEN ounce * rate / 31.1034768::DOUBLE END * 1.75 * 0.916 AS raw FROM q)
SELECT id, round(raw, 6) AS raw, CASE WHEN raw > 0 THEN round(ask / raw - 1, 6) END AS premium, round(CASE WHEN ask > 0 THEN (ask - bid) / ask ELSE 0 END, 6) AS spread FROM r"""
)
def gram_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coins of 1.75 grams, 916 fine: raw value, premium and spread."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (num.gram_price(price * 2, F.when(size % 10 == 0, 0.0).otherwise(size / 2.0)) * 1.75 * 0.916).alias("raw"), (price * size / 28).alias("ask"), (price * size / 29).alias("bid"))
    return q.select("id", F.round("raw", 6).alias("raw"), F.round(num.premium(F.col("ask"), F.col("raw")), 6).alias("premium"), F.round(num.spread_share(F.col("bid"), F.col("ask")), 6).alias("spread"))


@query(
    """SELECT o_orderkey AS id, CAST(CASE WHEN (o_orderkey % 100) % 2 = 0 THEN (o_orderkey % 100) // 2 ELSE CASE WHEN ((o_orderkey % 100) // 2) % 2 = 0 THEN (o_orderkey % 100) // 2 ELSE (o_orderkey % 100) // 2 + 1 END END AS DOUBLE) AS even, CAST(((o_orderkey % 100) + 1) // 2 AS DOUBLE) AS up,
  round((o_totalprice / (o_custkey + 100000) - 1) * 100, 6) AS drift, abs(o_totalprice / (o_custkey + 100000) - 1) * 100 >= 0.5 AS beyond,
  CASE WHEN abs((o_custkey % 41 - 20) / 10.0) >= 1.5 THEN 'extreme' WHEN abs((o_custkey % 41 - 20) / 10.0) >= 0.6 THEN 'high' ELSE 'normal' END AS unusual,
  round(pow(1 + (o_custkey % 50) / 100.0::DOUBLE, 1.0 / 12) - 1, 8) AS monthly FROM orders"""
)
def number_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties rounded to even and away from zero, drifts that trigger, how unusual a value is, and break-even rates."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    half = (k % 100) / 2.0
    drift = num.drift_percent(F.col("o_totalprice"), (c + 100000).cast("double"))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        num.half_even(half, 0).alias("even"),
        num.half_up(half, 0).alias("up"),
        F.round(drift, 6).alias("drift"),
        (F.abs(drift) >= 0.5).alias("beyond"),
        num.unusualness((c % 41 - 20) / 10.0).alias("unusual"),
        F.round(num.break_even_rate(F.lit(100.0), 100 + (c % 50), 12), 8).alias("monthly"),
    )
