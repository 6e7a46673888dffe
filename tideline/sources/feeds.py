"""Parsers of provider payloads that have landed as text: chart JSON, series CSV, fixings, RSS."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHART = "STRUCT<chart: STRUCT<result: ARRAY<STRUCT<timestamp: ARRAY<BIGINT>, indicators: STRUCT<quote: ARRAY<STRUCT<open: ARRAY<DOUBLE>, high: ARRAY<DOUBLE>, low: ARRAY<DOUBLE>, close: ARRAY<DOUBLE>, volume: ARRAY<BIGINT>>>>>>>>"
ITEM = r"(?s)<item>.*?</item>"


def _points(payloads: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    # a payload is parsed once, in a projection of its own, and its arrays are zipped: within a function of an element it would be parsed for each
    r = F.get(F.col("r")["chart"]["result"], F.lit(0))
    q = F.get(r["indicators"]["quote"], F.lit(0))
    # arrays may differ in length; a missing element is null, as is a missing array's
    array = lambda a, kind, name: F.coalesce(a, F.array().cast(f"array<{kind}>")).alias(name)
    arrays = [array(r["timestamp"], "bigint", "t"), *(array(q[c], "bigint" if c == "volume" else "double", c[0]) for c in ("open", "high", "low", "close", "volume"))]
    parsed = payloads.select(*keys, F.from_json(F.col(payload), CHART).alias("r")).select(*keys, *arrays)
    return parsed.select(*keys, F.explode(F.arrays_zip("t", *"ohlcv")).alias("p")).select(*keys, "p.*").where("t IS NOT NULL")


def chart_bars(payloads: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Intraday bars of chart payloads: open falls back to close and volume to 0; rows without high, low or close are dropped, as are broken payloads."""
    p = _points(payloads, payload, keys).where("h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL")
    return p.select(*keys, F.timestamp_seconds("t").alias("ts"), F.coalesce("o", "c").alias("o"), "h", "l", "c", F.coalesce("v", F.lit(0)).alias("v"))


def chart_days(payloads: DataFrame, payload: str, keys: list[str], digits: int | None = 2) -> DataFrame:
    """Daily points of chart payloads, rounded to ``digits`` unless that is None; rows with any null are dropped."""
    p = _points(payloads, payload, keys).where("h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL")
    value = lambda c: (F.col(c) if digits is None else F.round(c, digits)).alias({"h": "high", "l": "low", "c": "close"}[c])
    return p.select(*keys, F.to_date(F.timestamp_seconds("t")).alias("day"), value("h"), value("l"), value("c"))


def series_csv(lines: DataFrame, line: str, keys: list[str]) -> DataFrame:
    """(day, value) of ``date,value`` lines; lines that do not parse, as headers and ``.``, are skipped."""
    parts = F.split(F.col(line), ",")
    rows = lines.select(*keys, F.get(parts, F.lit(0)).try_cast("date").alias("day"), F.element_at(parts, -1).try_cast("double").alias("value"))
    return rows.where("day IS NOT NULL AND value IS NOT NULL")


def rss_items(feeds: DataFrame, xml: str, keys: list[str], most: int = 10) -> DataFrame:
    """(title, source, link, ts) of the first items of each feed; without a source element, it is what follows the title's last `` - ``."""
    tag = lambda item, name: F.nullif(F.trim(F.regexp_extract(item, rf"(?s)<{name}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1)), F.lit(""))
    items = F.slice(F.regexp_extract_all(F.col(xml), F.lit(ITEM), F.lit(0)), 1, most)
    rows = feeds.select(*keys, F.posexplode(items).alias("pos", "item"))
    title, source = tag(F.col("item"), "title"), tag(F.col("item"), "source")
    cut = F.nullif(F.regexp_extract(title, r"(?s)^(.*) - ([^-]+)$", 2), F.lit(""))
    rest = F.nullif(F.regexp_extract(title, r"(?s)^(.*) - ([^-]+)$", 1), F.lit(""))
    ts = F.try_to_timestamp(F.regexp_replace(tag(F.col("item"), "pubDate"), r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return rows.select(*keys, "pos", F.when(source.isNull() & cut.isNotNull(), rest).otherwise(title).alias("title"), F.coalesce(source, cut).alias("source"), tag(F.col("item"), "link").alias("link"), ts.alias("ts"))


def available(observations: DataFrame, lags: DataFrame) -> DataFrame:
    """Observations with the time they become known: their date and their series' lag in days (0 for an unknown series)."""
    return observations.join(lags, "series", "left").withColumn("available_at", F.date_add("obs_date", F.coalesce("lag_days", F.lit(0))).cast("timestamp")).drop("lag_days")


def one_source(rows: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """All rows of the first source, in ``order``, that has any for a key; sources are never blended."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    known = rows.withColumn("_rank", rank).where("_rank > 0")
    first = known.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    return known.join(first, keys).where("_rank = _first").drop("_rank", "_first")


def macro_store(lines: DataFrame, order: list[str], lags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store of all series of ``lags`` (series, lag_days), and what went wrong.

    ``lines`` (series, source, line) are ``date,value`` lines as the sources of
    ``order`` gave them. A series is taken whole from the first source that gave a
    valid row of it; others go on if one fails. The store has (series, obs_date,
    value, available_at, source); the errors (series, failed, used) name the sources
    before the one that was used, which is null if all failed.
    """
    parsed = series_csv(lines, "line", ["series", "source"]).join(lags.select("series"), "series", "left_semi")
    rows = one_source(parsed, order, ["series"]).withColumnRenamed("day", "obs_date")
    used = rows.groupBy("series").agg(F.first("source").alias("used"))
    names = F.array(*map(F.lit, order))
    tried = F.when(F.col("used").isNull(), names).otherwise(F.slice(names, 1, F.array_position(names, F.col("used")).cast("int") - 1))
    errors = lags.select("series").distinct().join(used, "series", "left").select("series", F.array_join(tried, ",").alias("failed"), "used").where("failed != ''")
    return available(rows, lags).select("series", "obs_date", "value", "available_at", "source"), errors


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key, so that a later one replaces an earlier one."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}") for c in rest))


CHART_META = "STRUCT<chart: STRUCT<result: ARRAY<STRUCT<meta: STRUCT<regularMarketPrice: DOUBLE, regularMarketTime: BIGINT, chartPreviousClose: DOUBLE, regularMarketDayHigh: DOUBLE, regularMarketDayLow: DOUBLE>, indicators: STRUCT<quote: ARRAY<STRUCT<close: ARRAY<DOUBLE>>>>>>>>"


def live_quote(payloads: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """(price, ts, previous, high, low, n) of intraday chart payloads; what the head of a payload lacks comes from its closes. Broken payloads give no row."""
    r = F.from_json(F.col(payload), CHART_META)["chart"]["result"][0]
    closes = F.array_compact(F.coalesce(r["indicators"]["quote"][0]["close"], F.array().cast("array<double>")))
    given = lambda c: F.nullif(r["meta"][c], F.lit(0.0))
    q = payloads.select(
        *keys,
        F.coalesce(given("regularMarketPrice"), F.try_element_at(closes, F.lit(-1))).alias("price"),
        F.timestamp_seconds(r["meta"]["regularMarketTime"]).alias("ts"),
        given("chartPreviousClose").alias("previous"),
        F.coalesce(given("regularMarketDayHigh"), F.array_max(closes)).alias("high"),
        F.coalesce(given("regularMarketDayLow"), F.array_min(closes)).alias("low"),
        F.size(closes).alias("n"),
    )
    return q.where("price IS NOT NULL")


def fixings(payloads: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """(day, value) of fixing payloads [{"d": day, "v": [first currency, ...]}]: the first value, of a day's several entries the first."""
    entries = F.posexplode(F.from_json(F.col(payload), "ARRAY<STRUCT<d: STRING, v: ARRAY<DOUBLE>>>")).alias("pos", "e")
    rows = payloads.select(*keys, entries).select(*keys, "pos", F.col("e.d").try_cast("date").alias("day"), F.get("e.v", F.lit(0)).alias("value"))
    return rows.where("day IS NOT NULL AND value IS NOT NULL").groupBy(*keys, "day").agg(F.min_by("value", "pos").alias("value"))


def csv_columns(lines: DataFrame, line: str, header: str, names: Mapping[str, Sequence[str]], keys: list[str]) -> DataFrame:
    """Columns of CSV lines chosen by name: ``names`` maps a column to what its header may be called; a column that no header names is null.

    ``header`` is the file's first line, whose names are compared without regard to
    case. Quoted fields may hold commas; lines that are too short have nulls.
    """
    heads = [h.strip().lower() for h in next(csv.reader([header]))]
    parts = F.from_csv(F.col(line), ", ".join(f"c{k} STRING" for k in range(len(heads))), {"escape": '"'})
    place = {c: next((heads.index(n.lower()) for n in called if n.lower() in heads), None) for c, called in names.items()}
    value = lambda k: F.lit(None).cast("string") if k is None else F.nullif(F.trim(F.col("_parts")[f"c{k}"]), F.lit(""))
    return lines.where(F.col(line) != header).withColumn("_parts", parts).select(*keys, *(value(k).alias(c) for c, k in place.items()))


def with_provenance(bars: DataFrame, order: list[tuple[str, str]], valid: Column) -> DataFrame:
    """The bars of the first source whose bars are all valid, with ``price_source`` and ``price_instrument``.

    ``order`` lists (source, instrument); a source with one bad bar is passed over.
    """
    bad = bars.groupBy("source").agg(F.max((~F.coalesce(valid, F.lit(False))).cast("int")).alias("bad")).where("bad = 0")
    rank = F.create_map(*(F.lit(x) for k, (s, _) in enumerate(order) for x in (s, k)))
    instrument = F.create_map(*map(F.lit, (x for pair in order for x in pair)))
    best = bad.withColumn("rank", rank[F.col("source")]).where("rank IS NOT NULL").agg(F.min_by("source", "rank").alias("source"))
    return bars.join(F.broadcast(best), "source").withColumns({"price_source": F.col("source"), "price_instrument": instrument[F.col("source")]}).drop("source")


def complete_futures(bars: DataFrame, include_partial: bool = False) -> DataFrame:
    """Bars with a close, without the running day unless asked for; an unknown volume is 0."""
    known = bars.where("close IS NOT NULL")
    known = known if include_partial else known.where("NOT partial")
    return known.withColumn("volume", F.coalesce("volume", F.lit(0.0))).drop("partial")


def upcoming(events: DataFrame, today: Column, days: int) -> DataFrame:
    """Events (name, day, clock) within the next days, with the clock three hours east, the days until and whether they are today's."""
    left = F.datediff("day", today)
    clock = F.concat(F.lpad(((F.substring("clock", 1, 2).cast("int") + 3) % 24).cast("string"), 2, "0"), F.substring("clock", 3, 3))
    return events.withColumn("days_until", left).where(F.col("days_until").between(0, days)).select("name", "day", "clock", clock.alias("local_clock"), "days_until", (F.col("days_until") == 0).alias("today"))


def recent(rows: DataFrame, stamp: str, since: Column, keep_unknown: bool) -> DataFrame:
    """Rows stamped since then; those whose stamp does not parse stay or go by ``keep_unknown``."""
    ts = F.try_to_timestamp(F.col(stamp))
    return rows.where(F.coalesce(ts >= since, F.lit(keep_unknown)))
