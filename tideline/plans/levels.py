"""Queries over price levels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as bar_ops
from ..operators import levels as ops
from ..operators import trend
from ..operators import windows as win
from ..sources.tables import BARS, bars_daily, saved, table
from .bars import rounded
from .recursion import _indicators as strength
from .registry import SQL, query
from .windows import _channel as channel_sql
from .windows import all_rounded, frame, swing_sql

TODAY = "1998-06-18"
_LAST = "last_ AS (SELECT symbol, arg_max(close, day) AS close FROM bars GROUP BY symbol)"
_PERIOD = f"""per AS (SELECT symbol, CAST(date_trunc('month', day) AS DATE) AS bucket, max(high) AS high, min(low) AS low, arg_max(close, day) AS close FROM bars GROUP BY 1, 2),
pm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) AS r FROM per WHERE CAST(bucket + INTERVAL 1 MONTH AS DATE) <= DATE '{TODAY}') WHERE r = 1)"""
_PIVOTS = "piv AS (SELECT symbol, unnest(['p', 'r1', 's1', 'r2', 's2', 'r3', 's3', 'fr1', 'fr2', 'fr3', 'fs1', 'fs2', 'fs3']) AS name, unnest([p, 2 * p - low, 2 * p - high, p + s, p - s, high + 2 * (p - low), low - 2 * (high - p), p + 0.382::DOUBLE * s, p + 0.618::DOUBLE * s, p + s, p - 0.382::DOUBLE * s, p - 0.618::DOUBLE * s, p - s]) AS price FROM (SELECT *, (high + low + close) / 3 AS p, high - low AS s FROM pm))"


def _pivots(bars: DataFrame) -> DataFrame:
    return ops.pivots(bar_ops.last_complete(bars, "month", F.lit(TODAY).cast("date")))


def _last(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max_by("close", "day").alias("close"))


@query(f"WITH {BARS}, {_PERIOD}, {_PIVOTS} SELECT symbol, name, round(price, 6) AS price FROM piv")
def pivots_classic_fib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(_pivots(bars_daily(spark, sf_dir)))


@query(
    f"""WITH {BARS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r FROM bars) WHERE r <= 250),
e AS (SELECT symbol, arg_min(day, (-high, day)) AS td, max(high) AS top, arg_min(day, (low, day)) AS bd, min(low) AS bottom FROM b GROUP BY symbol)
SELECT symbol, bd < td AS upward, round(top, 8) AS top, round(bottom, 8) AS bottom, ratio, round(CASE WHEN bd < td THEN top - sh * (top - bottom) ELSE bottom + sh * (top - bottom) END, 6) AS price
FROM e, (SELECT unnest([0.236::DOUBLE, 0.382::DOUBLE, 0.5::DOUBLE, 0.618::DOUBLE, 0.786::DOUBLE, 1.272::DOUBLE, 1.618::DOUBLE]) AS ratio), LATERAL (SELECT CASE WHEN ratio > 1 THEN 1 - ratio ELSE ratio END AS sh)"""
)
def fib_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(ops.fibonacci(bars_daily(spark, sf_dir)), "price", digits=6), "top", "bottom")


@query(
    f"""WITH {BARS}, {_PERIOD}, {_PIVOTS}, {_LAST}, every_ AS (SELECT symbol, name, price FROM piv UNION ALL SELECT symbol, 'round ' || price, price FROM (SELECT symbol, unnest(generate_series(CAST(ceil(close * 0.94 / 50) * 50 AS BIGINT), CAST(floor(close * 1.06 / 50) * 50 AS BIGINT), 50)) AS price FROM last_)),
l AS (SELECT every_.*, close, CASE WHEN price > close THEN 'resistance' ELSE 'support' END AS side FROM every_ JOIN last_ USING (symbol) WHERE abs(price / close - 1) <= 0.12),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY abs(price - close), name) AS rank FROM l)
SELECT symbol, side, CAST(rank AS INTEGER) AS rank, name, round(price, 6) AS price, round(price / close - 1, 6) AS gap FROM r WHERE rank <= 3"""
)
def level_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots and round numbers around the last close."""
    b = bars_daily(spark, sf_dir)
    last = _last(b)
    tens = ops.round_levels(last).select("symbol", F.concat(F.lit("round "), F.col("price").cast("long").cast("string")).alias("name"), F.col("price").cast("double").alias("price"))
    return all_rounded(ops.ladder(_pivots(b).select("symbol", "name", "price").unionByName(tens), last))


@query(f"WITH {BARS}, {_PERIOD}, {_PIVOTS}, {_LAST} SELECT symbol, round(max(price) FILTER (WHERE price < close), 6) AS support, round(min(price) FILTER (WHERE price > close), 6) AS resistance FROM piv JOIN last_ USING (symbol) GROUP BY symbol")
def nearest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_daily(spark, sf_dir)
    return all_rounded(ops.nearest(_pivots(b), _last(b)))


_SWINGS = f"{swing_sql(5)}, lv AS (SELECT symbol, price, CASE kind WHEN 'high' THEN 1 ELSE 2 END AS priority, kind || strftime(day, '%Y%m%d') AS name FROM swing)"


def _swing_levels(bars: DataFrame) -> DataFrame:
    s = win.swings(bars, 5)
    return s.select("symbol", "price", F.when(F.col("kind") == "high", 1).otherwise(2).alias("priority"), F.concat("kind", F.date_format("day", "yyyyMMdd")).alias("name"))


@query(
    f"""WITH {BARS}, {_SWINGS}, n AS (SELECT *, CASE WHEN price - lag(price) OVER w > 5 THEN 1 ELSE 0 END AS new FROM lv WINDOW w AS (PARTITION BY symbol ORDER BY price, priority, name)),
c AS (SELECT *, CAST(sum(new) OVER (PARTITION BY symbol ORDER BY price, priority, name) AS BIGINT) AS cluster FROM n)
SELECT symbol, cluster, round(avg(price), 6) AS price, arg_min(name, (priority, name)) AS name, count(*) AS n FROM c GROUP BY symbol, cluster"""
)
def cluster_single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.cluster(_swing_levels(bars_daily(spark, sf_dir)), F.lit(5.0)).drop("names"))


_ATR = f"""atr_ AS (SELECT symbol, arg_max(atr, day) AS atr FROM (SELECT symbol, day, avg(tr) OVER {frame(14)} AS atr FROM (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day))) GROUP BY symbol)"""
_RECENT = f"""{swing_sql(3, "b250")}, nb AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) - 1 AS age FROM bars),
rs AS (SELECT swing.symbol, price, kind || strftime(swing.day, '%Y%m%d') AS name, age FROM swing JOIN nb ON nb.symbol = swing.symbol AND nb.day = swing.day),
so AS (SELECT rs.*, 0.5 * atr AS tol, row_number() OVER (PARTITION BY rs.symbol ORDER BY price, rs.name) AS i FROM rs JOIN atr_ USING (symbol)),
sw AS (SELECT symbol, i, 0 AS cluster, price AS sum, 1 AS n FROM so WHERE i = 1 UNION ALL
  SELECT so.symbol, so.i, CASE WHEN so.price - sw.sum / sw.n <= tol THEN sw.cluster ELSE sw.cluster + 1 END, CASE WHEN so.price - sw.sum / sw.n <= tol THEN sw.sum + so.price ELSE so.price END, CASE WHEN so.price - sw.sum / sw.n <= tol THEN sw.n + 1 ELSE 1 END
  FROM sw JOIN so ON so.symbol = sw.symbol AND so.i = sw.i + 1),
swc AS (SELECT so.symbol, cluster, avg(price) AS price, count(*) AS touches, min(age) AS age FROM sw JOIN so ON so.symbol = sw.symbol AND so.i = sw.i GROUP BY so.symbol, cluster)"""
_B250 = "b250 AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r FROM bars) WHERE r <= 250)"


def _atr(bars: DataFrame) -> DataFrame:
    a = bars.withColumn("tr", win.true_range()).select("symbol", "day", F.avg("tr").over(win.last_rows(14)).alias("atr"))
    return a.groupBy("symbol").agg(F.max_by("atr", "day").alias("atr"))


def _recent(bars: DataFrame, n: int = 250) -> DataFrame:
    return bars.withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day"))) - 1).where(F.col("age") < n)


def swing_clusters(bars: DataFrame, tolerances: DataFrame) -> DataFrame:
    """(symbol, cluster, price, touches, recency) of the last 250 bars' swings; recency halves every 126 bars since the last touch."""
    recent = _recent(bars)
    s = win.swings(recent, 3).join(recent.select("symbol", "day", "age"), ["symbol", "day"]).select("symbol", "price", F.concat("kind", F.date_format("day", "yyyyMMdd")).alias("name"), F.lit(1.0).alias("weight"), F.lit(1).alias("touches"), "age")
    ages = s.groupBy("symbol", "name").agg(F.min("age").alias("age"))
    m = ops.merged(s.drop("age"), tolerances)
    named = m.select("symbol", "cluster", "mean", "touches", F.explode(F.split("names", r"\|")).alias("name")).join(ages, ["symbol", "name"])
    g = named.groupBy("symbol", "cluster").agg(F.first("mean").alias("price"), F.first("touches").alias("touches"), F.min("age").alias("age"))
    return g.select("symbol", "cluster", "price", "touches", F.exp(F.lit(-math.log(2)) * F.col("age") / 126).alias("recency"))


@query(f"WITH RECURSIVE {BARS}, {_ATR}, {_B250}, {_RECENT} SELECT symbol, cluster, round(price, 6) AS price, touches, round(exp(-ln(2) * age / 126), 6) AS recency FROM swc")
def cluster_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = saved(bars_daily(spark, sf_dir))
    return all_rounded(swing_clusters(b, _atr(b).select("symbol", (F.col("atr") * 0.5).alias("tolerance"))))


@query(
    f"""WITH {BARS}, {_LAST} SELECT symbol, CAST(price AS BIGINT) AS price, CASE WHEN price % 100 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS weight
FROM (SELECT symbol, unnest(generate_series(CAST(ceil(close * 0.94 / 50) * 50 AS BIGINT), CAST(floor(close * 1.06 / 50) * 50 AS BIGINT), 50)) AS price FROM last_)"""
)
def round_number_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.round_levels(_last(bars_daily(spark, sf_dir)))


@query(f"WITH {BARS}, s AS (SELECT symbol, day, {', '.join(f'avg(close) OVER {frame(n)} AS m{n}' for n in (50, 100, 200))} FROM bars) SELECT symbol, unnest(['sma50', 'sma100', 'sma200']) AS name, unnest([round(arg_max(m50, day), 6), round(arg_max(m100, day), 6), round(arg_max(m200, day), 6)]) AS price FROM s GROUP BY symbol")
def moving_average_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = win.moving_averages(bars_daily(spark, sf_dir), (50, 100, 200)).groupBy("symbol").agg(F.max_by(F.struct("sma_50", "sma_100", "sma_200"), "day").alias("m"))
    named = F.explode(F.array(*(F.struct(F.lit(f"sma{n}").alias("name"), F.col(f"m.sma_{n}").alias("price")) for n in (50, 100, 200))))
    return all_rounded(s.select("symbol", named.alias("l")).select("symbol", "l.name", "l.price").where("price IS NOT NULL"))


@query(f"WITH {BARS} SELECT symbol, round(max(high), 8) AS price, arg_min(day, (-high, day)) AS day FROM bars GROUP BY symbol")
def all_time_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_daily(spark, sf_dir).groupBy("symbol").agg(F.max("high").alias("price"), F.min_by("day", F.struct(-F.col("high"), "day")).alias("day"))
    return rounded(b, "price")


@query(
    f"""WITH {BARS}, {_SWINGS}, x AS (SELECT symbol, max(day) AS last FROM bars GROUP BY symbol), sw AS (SELECT swing.symbol, price, exp(-ln(2) * datediff('day', day, last) / 126.0) AS w FROM swing JOIN x ON x.symbol = swing.symbol)
SELECT symbol, round(sum(price * w) / sum(w), 6) AS centre, round(sum(w), 6) AS score, count(*) AS touches FROM sw GROUP BY symbol"""
)
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swings weighted by recency (half-life of 126 days)."""
    b = bars_daily(spark, sf_dir)
    s = win.swings(b, 5).join(b.groupBy("symbol").agg(F.max("day").alias("last")), "symbol")
    w = F.exp(F.lit(-math.log(2)) * F.datediff("last", "day") / 126.0)
    s = s.withColumn("w", w).groupBy("symbol").agg((F.sum(F.col("price") * F.col("w")) / F.sum("w")).alias("centre"), F.sum("w").alias("score"), F.count("*").alias("touches"))
    return all_rounded(s)


_MOVES = f"""v_ AS (SELECT symbol, arg_max(s, day) AS s, arg_max(g, day) AS g FROM (SELECT symbol, day, stddev_pop(r) OVER {frame(63)} AS s, ln(close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY day)) AS g FROM (
  SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS r FROM bars)) GROUP BY symbol),
mv AS (SELECT symbol, close, s, g, s * sqrt(5) AS move, least(100, 50 * abs(g) / (s * sqrt(20))) AS strength FROM last_ JOIN v_ USING (symbol))"""


def _moves(bars: DataFrame) -> DataFrame:
    """(symbol, close, s, g, move, strength): the deviation of daily returns, the return of 20 bars, and what is expected of five."""
    r = bars.withColumn("r", win.log_return()).select("symbol", "day", F.stddev_pop("r").over(win.last_rows(63)).alias("s"), F.log(F.col("close") / F.lag("close", 20).over(win.ordered())).alias("g"))
    v = r.groupBy("symbol").agg(F.max_by("s", "day").alias("s"), F.max_by("g", "day").alias("g"))
    strength = F.least(F.lit(100.0), 50 * F.abs("g") / (F.col("s") * F.sqrt(F.lit(20.0))))
    return _last(bars).join(v, "symbol").select("symbol", "close", "s", "g", (F.col("s") * F.sqrt(F.lit(5.0))).alias("move"), strength.alias("strength"))


@query(
    f"""WITH {BARS}, {_PERIOD}, {_PIVOTS}, {_LAST}, {_MOVES}, z AS (SELECT piv.symbol, name, price, CASE WHEN move > 0 AND price <> close THEN move / abs(price / close - 1) END AS reach, strength FROM piv JOIN mv USING (symbol)),
y AS (SELECT *, CASE WHEN reach IS NOT NULL THEN sqrt(least(1, reach) * strength / 100) END AS score FROM z)
SELECT symbol, name, round(price, 6) AS price, round(reach, 6) AS reach, round(score, 6) AS score, CASE WHEN score >= 2.0 / 3 THEN 'strong' WHEN score >= 1.0 / 3 THEN 'medium' WHEN score IS NOT NULL THEN 'weak' END AS label FROM y"""
)
def break_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots against the move that is expected of five bars, and the strength of the last twenty."""
    b = saved(bars_daily(spark, sf_dir))
    return all_rounded(ops.break_potential(_pivots(b), _moves(b).drop("s", "g")))


_LIVE = "live_ AS (SELECT symbol, close, close * (1 + g / 4) AS live, 0.3 * atr AS margin FROM mv JOIN atr_ USING (symbol))"


def _live(bars: DataFrame) -> DataFrame:
    """A live price for each symbol (its close, moved by a quarter of its last twenty bars' return), and the margin of 0.3 ranges."""
    return _moves(bars).join(_atr(bars), "symbol").select("symbol", "close", (F.col("close") * (1 + F.col("g") / 4)).alias("live"), (F.col("atr") * 0.3).alias("margin"))


@query(
    f"""WITH {BARS}, {_PERIOD}, {_PIVOTS}, {_LAST}, {_ATR}, {_MOVES}, {_LIVE}, l AS (SELECT piv.symbol, name, price, live, close, CASE WHEN abs(price - live) <= margin THEN 'touching' WHEN price > live THEN 'resistance' ELSE 'support' END AS role FROM piv JOIN live_ USING (symbol)),
e AS (SELECT symbol, name, price, live, role FROM l UNION ALL SELECT symbol, name, price, live, 'crossed' FROM l WHERE (price - close) * (price - live) < 0),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, role ORDER BY abs(price - live), name) AS rank FROM e)
SELECT symbol, name, round(price, 6) AS price, role, CAST(rank AS INTEGER) AS rank, round(price / live - 1, 6) AS gap FROM r WHERE role IN ('touching', 'crossed') OR rank <= 3"""
)
def live_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = saved(bars_daily(spark, sf_dir))
    return all_rounded(ops.live_levels(_pivots(b), _live(b)))


_CANDIDATES = f"""fw AS (SELECT symbol, CAST(day + CAST((5 - isodow(day) + 7) % 7 AS INTEGER) AS DATE) AS label, arg_max(close, day) AS close FROM bars GROUP BY 1, 2),
ma AS (SELECT symbol, unnest(['sma50', 'sma100', 'sma200']) AS name, unnest([arg_max(m50, day), arg_max(m100, day), arg_max(m200, day)]) AS price, unnest([0.7::DOUBLE, 0.6::DOUBLE, 1.0::DOUBLE]) AS weight FROM (SELECT symbol, day, {", ".join(f"CASE WHEN count(*) OVER {frame(n)} = {n} THEN avg(close) OVER {frame(n)} END AS m{n}" for n in (50, 100, 200))} FROM bars) GROUP BY symbol
  UNION ALL SELECT symbol, unnest(['sma10 weekly', 'sma40 weekly']), unnest([arg_max(m10, label), arg_max(m40, label)]), unnest([0.6::DOUBLE, 0.9::DOUBLE]) FROM (SELECT symbol, label, {", ".join(f"CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY label ROWS {n - 1} PRECEDING) = {n} THEN avg(close) OVER (PARTITION BY symbol ORDER BY label ROWS {n - 1} PRECEDING) END AS m{n}" for n in (10, 40))} FROM fw) GROUP BY symbol),
cand AS (SELECT symbol, price, 'swing ' || cluster AS name, touches * exp(-ln(2) * age / 126) AS weight, touches FROM swc UNION ALL SELECT symbol, price, name, 1.0::DOUBLE, 0 FROM piv WHERE name IN ('p', 'r1', 's1', 'r2', 's2', 'r3', 's3')
  UNION ALL SELECT symbol, price, name, weight, 0 FROM ma WHERE price IS NOT NULL UNION ALL SELECT symbol, price, 'round ' || price, CASE WHEN price % 100 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END, 0 FROM (SELECT symbol, unnest(generate_series(CAST(ceil(close * 0.94 / 50) * 50 AS BIGINT), CAST(floor(close * 1.06 / 50) * 50 AS BIGINT), 50)) AS price FROM last_)
  UNION ALL SELECT symbol, max(high), 'all-time high', 1.0::DOUBLE, 0 FROM bars GROUP BY symbol),
co AS (SELECT cand.symbol, price::DOUBLE AS price, name, weight, touches, 0.5 * atr AS tol, row_number() OVER (PARTITION BY cand.symbol ORDER BY price, name) AS i FROM cand JOIN atr_ USING (symbol)),
cm AS (SELECT symbol, i, 0 AS cluster, price AS sum, 1 AS n FROM co WHERE i = 1 UNION ALL
  SELECT co.symbol, co.i, CASE WHEN co.price - cm.sum / cm.n <= tol THEN cm.cluster ELSE cm.cluster + 1 END, CASE WHEN co.price - cm.sum / cm.n <= tol THEN cm.sum + co.price ELSE co.price END, CASE WHEN co.price - cm.sum / cm.n <= tol THEN cm.n + 1 ELSE 1 END FROM cm JOIN co ON co.symbol = cm.symbol AND co.i = cm.i + 1)"""


def level_candidates(bars: DataFrame) -> DataFrame:
    """(symbol, price, name, weight, touches): swing clusters, monthly pivots, daily and weekly means, round numbers and the highest high."""
    tolerances = _atr(bars).select("symbol", (F.col("atr") * 0.5).alias("tolerance"))
    last, none = _last(bars), F.lit(0).cast("long").alias("touches")
    swings = swing_clusters(bars, tolerances).select("symbol", "price", F.concat(F.lit("swing "), F.col("cluster").cast("string")).alias("name"), (F.col("touches") * F.col("recency")).alias("weight"), "touches")
    pivots = _pivots(bars).where(F.col("name").isin(*ops.CLASSIC)).select("symbol", "price", "name", F.lit(1.0).alias("weight"), none)
    weekly = bar_ops.resample(bars, bar_ops.week_ending_friday(F.col("day"))).withColumnRenamed("label", "day")
    means = []
    for df, suffix, weights in ((bars, "", {50: 0.7, 100: 0.6, 200: 1.0}), (weekly, " weekly", {10: 0.6, 40: 0.9})):
        m = win.moving_averages(df, tuple(weights))
        each = F.explode(F.array(*(F.struct(F.lit(f"sma{n}{suffix}").alias("name"), F.col(f"l.sma_{n}").alias("price"), F.lit(x).alias("weight")) for n, x in weights.items()))).alias("m")
        row = m.groupBy("symbol").agg(F.max_by(F.struct(*m.columns[2:]), "day").alias("l"))
        means.append(row.select("symbol", each).where("m.price IS NOT NULL").select("symbol", "m.price", "m.name", "m.weight", none))
    rounds = ops.round_levels(last).select("symbol", F.col("price").cast("double").alias("price"), F.concat(F.lit("round "), F.col("price").cast("string")).alias("name"), "weight", none)
    high = bars.groupBy("symbol").agg(F.max("high").alias("price")).select("symbol", "price", F.lit("all-time high").alias("name"), F.lit(1.0).alias("weight"), none)
    out = swings
    for x in (pivots, *means, rounds, high):
        out = out.unionByName(x)
    return out


@query(
    f"""WITH RECURSIVE {BARS}, {_ATR}, {_B250}, {_RECENT}, {_PERIOD}, {_PIVOTS}, {_LAST}, {_CANDIDATES}
SELECT co.symbol, cluster, round(CASE WHEN sum(weight) > 0 THEN sum(price * weight) / sum(weight) ELSE avg(price) END, 5) AS price, round(sum(weight), 5) AS score, string_agg(name, '|' ORDER BY price, name) AS names, CAST(count(*) AS INTEGER) AS n, CAST(sum(touches) AS BIGINT) AS touches FROM cm JOIN co ON co.symbol = cm.symbol AND co.i = cm.i GROUP BY co.symbol, cluster"""
)
def merged_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates, merged within half a range; a cluster's price is weighted, its score the weights' sum."""
    b = saved(bars_daily(spark, sf_dir))
    m = ops.merged(saved(level_candidates(b)), _atr(b).select("symbol", (F.col("atr") * 0.5).alias("tolerance")))
    return all_rounded(m.drop("mean"), 5)


@query(
    f"""WITH {BARS}, {swing_sql(5)}, pos AS (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS x FROM bars),
five AS (SELECT w.symbol, kind, x, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY day DESC) AS r FROM swing) w JOIN pos ON pos.symbol = w.symbol AND pos.day = w.day WHERE r <= 5),
li AS (SELECT a.symbol, a.kind, a.x AS xa, b.x AS xb, a.price AS pa, b.price AS pb, (b.price - a.price) / (b.x - a.x) AS slope FROM five a JOIN five b ON a.symbol = b.symbol AND a.kind = b.kind AND a.x < b.x),
t AS (SELECT li.*, (SELECT sum((abs(price / (pa + slope * (x - xa)) - 1) <= 0.01)::INT) FROM five f WHERE f.symbol = li.symbol AND f.kind = li.kind) AS touches,
  (SELECT max((CASE WHEN li.kind = 'low' THEN close < (pa + slope * (x - xa)) * 0.99 ELSE close > (pa + slope * (x - xa)) * 1.01 END)::INT) FROM pos WHERE pos.symbol = li.symbol AND x > xb) AS broken FROM li)
SELECT symbol, kind, CAST(xa AS INTEGER) AS xa, CAST(xb AS INTEGER) AS xb, round(pa, 8) AS pa, round(pb, 8) AS pb, CAST(touches AS BIGINT) AS touches, CAST(broken AS INTEGER) AS broken FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY 1 - broken DESC, touches DESC, xb DESC, xa) AS k FROM t WHERE broken IS NOT NULL) WHERE k = 1"""
)
def trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_daily(spark, sf_dir)
    return rounded(ops.trend_lines(win.swings(b, 5), b), "pa", "pb")


@query(
    f"""WITH {BARS}, {_LAST}, {_ATR}, {_MOVES}, z AS (SELECT symbol, close * (1 + 1.5 * g) AS near, close * 1.28 * s * sqrt(30) AS band, atr FROM mv JOIN atr_ USING (symbol)),
y AS (SELECT *, near - 0.72 * band AS buy_low, near - 0.38 * band AS buy_high, near + 0.35 * band AS sell_low, near + 0.72 * band AS sell_high FROM z), x AS (SELECT *, (buy_low + buy_high) / 2 AS entry, buy_low - greatest(1.5 * atr, 0.18 * band) AS stop FROM y)
SELECT symbol, {", ".join(f"round({c}, 5) AS {c}" for c in ("near", "band", "buy_low", "buy_high", "sell_low", "sell_high", "entry", "stop"))}, round(1000 / greatest(1, entry - stop), 5) AS units FROM x"""
)
def trade_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones for 30 days: the forecast carries the last twenty bars' return on, the band is 1.28 deviations."""
    b = saved(bars_daily(spark, sf_dir))
    f = _moves(b).join(_atr(b), "symbol").select("symbol", "close", (F.col("g") * 1.5).alias("mean"), (F.col("s") * F.sqrt(F.lit(30.0)) * 1.28).alias("error"), (F.col("atr") / F.col("close")).alias("atr"))
    return all_rounded(ops.trade_zones(f, 100_000.0, 1.0), 5)


@query(
    """WITH q AS (SELECT p_partkey AS id, p_retailprice - p_size AS bid, p_retailprice AS ask, p_retailprice * (p_partkey % 10) / 8.0::DOUBLE AS low, p_retailprice * (1 + (p_size % 7 - 1) / 20.0::DOUBLE) AS high, p_retailprice * (p_size % 5) / 3.0::DOUBLE AS previous FROM part),
r AS (SELECT *, high - low AS band, low > 0 AND high > low AND low >= ask * 0.5 AND ask BETWEEN low AND high AS ok FROM q)
SELECT id, round(ask - bid, 6) AS spread, ok AS has_range, CASE WHEN ok THEN round((ask - low) / band * 100, 6) END AS position, CASE WHEN ok AND previous > 0 AND previous BETWEEN low - band * 0.5 AND high + band * 0.5 THEN round(ask / previous - 1, 6) END AS change FROM r"""
)
def quote_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes made of parts; some have an absurd low, an ask outside the range or a stale previous close."""
    ask = F.col("p_retailprice")
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (ask - F.col("p_size")).alias("bid"), ask.alias("ask"), (ask * (F.col("p_partkey") % 10) / 8.0).alias("low"), (ask * (1 + (F.col("p_size") % 7 - 1) / 20.0)).alias("high"), (ask * (F.col("p_size") % 5) / 3.0).alias("previous"))
    return all_rounded(ops.read_quotes(q))


def _last_of(sql: str, *columns: str, as_: str = "") -> str:
    return f"(SELECT symbol, {', '.join(f'arg_max({c}, day) AS {c}{as_}' for c in columns)} FROM ({sql}) GROUP BY symbol)"


_LINE = "(SELECT symbol, pa + (pb - pa) / (xb - xa) * (n - xa) AS now, pa + (pb - pa) / (xb - xa) * (n + 5 - xa) AS later, broken = 1 AS broken FROM ({lines}) l JOIN cnt USING (symbol) WHERE kind = '{kind}')"


@query(
    f"""WITH {BARS}, cnt AS (SELECT symbol, count(*) AS n, max(day) AS day, arg_max(close, day) AS price FROM bars GROUP BY symbol),
av AS (SELECT symbol, arg_max(m50, day) AS m50, arg_max(m200, day) AS m200 FROM (SELECT symbol, day, avg(close) OVER {frame(50)} AS m50, avg(close) OVER {frame(200)} AS m200 FROM bars) GROUP BY symbol),
sw AS (SELECT symbol, string_agg(substr(kind, 1, 1) || ' ' || day, ', ' ORDER BY r DESC) AS swings FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC, kind) AS r FROM ({SQL["fractal_swings"]})) WHERE r <= 8 GROUP BY symbol)
SELECT symbol, cnt.day, round(price, 4) AS price, round(atr, 4) AS atr, round(0.5 * atr, 4) AS tolerance, round(adx, 4) AS adx, state AS structure, round(low_1, 4) AS last_low, round(high_1, 4) AS last_high,
  CASE WHEN n >= 50 THEN round(price / m50 - 1, 4) END AS from_sma_50, CASE WHEN n >= 200 THEN round(price / m200 - 1, 4) END AS from_sma_200, CASE WHEN n >= 200 THEN m50 > m200 END AS sma_50_above,
  round(su.now, 4) AS support, round(su.later, 4) AS support_ahead, su.broken AS support_broken, round(re.now, 4) AS resistance, round(re.later, 4) AS resistance_ahead, re.broken AS resistance_broken,
  {", ".join(f"round({c}_{n}, 4) AS {c}_{n}" for n in (60, 120, 250) for c in ("slope", "r2", "place"))}, swings
FROM cnt JOIN av USING (symbol) LEFT JOIN {_last_of(SQL["atr_adx"], "atr", "adx")} st USING (symbol) LEFT JOIN ({SQL["dow_state"]}) d USING (symbol)
LEFT JOIN {_LINE.format(lines=SQL["trend_lines"], kind="low")} su USING (symbol) LEFT JOIN {_LINE.format(lines=SQL["trend_lines"], kind="high")} re USING (symbol)
{" ".join(f"LEFT JOIN {_last_of(channel_sql(n), 'slope', 'r2', 'place', as_=f'_{n}')} c{n} USING (symbol)" for n in (60, 120, 250))} LEFT JOIN sw USING (symbol)"""
)
def trend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = saved(bars_daily(spark, sf_dir))
    return all_rounded(trend.report(b, strength(b)), 4)
