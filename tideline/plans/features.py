"""Queries that assemble and guard the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof
from ..operators import features as ops
from ..operators.windows import gold_features
from ..sources.tables import BARS, MACRO, bars_daily, macro_observations, saved, table
from .bars import rounded
from .joins import LABELS, _first
from .registry import SQL, query
from .windows import all_rounded

SERIES = ("1-URGENT", "2-HIGH")
_GOLD = SQL["gold_features_daily"].replace("WITH " + BARS + ", ", "", 1)
_GOLD_CTE, _GOLD_SELECT = _GOLD[: _GOLD.rindex("\nSELECT")], _GOLD[_GOLD.rindex("SELECT") :]
_MACRO = "mac AS (SELECT series, obs_date AS day, value FROM macro WHERE vintage = 'initial' AND series IN ('1-URGENT', '2-HIGH'))"
_ASOF = """dd AS (SELECT DISTINCT b.day, s.series FROM bars b, (SELECT unnest(['1-URGENT', '2-HIGH']) AS series) s),
n AS (SELECT dd.series, dd.day, m.value FROM dd ASOF LEFT JOIN mac m ON dd.series = m.series AND dd.day >= m.day),
o AS (SELECT dd.series, dd.day, m.value AS before FROM dd ASOF LEFT JOIN mac m ON dd.series = m.series AND dd.day - 90 >= m.day),
w AS (SELECT day, max(value) FILTER (WHERE series = '1-URGENT') AS a, max(value) FILTER (WHERE series = '2-HIGH') AS b, max(value / nullif(before, 0) - 1) FILTER (WHERE series = '1-URGENT') AS ca, max(value / nullif(before, 0) - 1) FILTER (WHERE series = '2-HIGH') AS cb
  FROM n JOIN o USING (series, day) GROUP BY day)""".replace("n AS (SELECT dd", "nn AS (SELECT dd").replace("FROM n JOIN", "FROM nn JOIN").replace("w AS (", "wide AS (")


def _macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = macro_observations(spark, sf_dir).where((F.col("vintage") == "initial") & F.col("series").isin(*SERIES))
    return m.select("series", F.col("obs_date").alias("day"), "value")


@query(
    f"""WITH {BARS}, {_GOLD_CTE}, gold AS ({_GOLD_SELECT}), {MACRO}, {_MACRO}, {_ASOF}, {LABELS},
t AS (SELECT symbol, day, max(target_return) FILTER (WHERE horizon = 7) AS t7, max(target_return) FILTER (WHERE horizon = 14) AS t14, max(target_return) FILTER (WHERE horizon = 30) AS t30 FROM labels_ GROUP BY symbol, day)
SELECT gold.*, a AS "1_urgent_level", round(ca, 6) AS "1_urgent_change", b AS "2_high_level", round(cb, 6) AS "2_high_change", round(t7, 6) AS target_7d, round(t14, 6) AS target_14d, round(t30, 6) AS target_30d
FROM gold JOIN wide USING (day) LEFT JOIN t USING (symbol, day) WHERE a IS NOT NULL AND b IS NOT NULL AND ca IS NOT NULL AND cb IS NOT NULL"""
)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ops.feature_table(bars_daily(spark, sf_dir), _macro(spark, sf_dir))
    return rounded(rounded(df, *[c for c, t in df.dtypes if t == "double" and c != "close" and not c.endswith("level")], digits=6), "close")


@query()
def feature_table_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all macro series, where ``feature_table`` and its SQL take two."""
    df = ops.feature_table(bars_daily(spark, sf_dir), _first(spark, sf_dir))
    return rounded(rounded(df, *[c for c, t in df.dtypes if t == "double" and c != "close" and not c.endswith("level")], digits=6), "close")


@query(
    f"""WITH {BARS}, b AS (SELECT symbol, day, high, floor(dayofyear(day) / 400) AS flat, CASE WHEN symbol = 'A' THEN NULL ELSE 1 END AS gap, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r FROM bars)
SELECT symbol, f AS feature, CASE f WHEN 'high' THEN count(high) = 16 AND min(high) = max(high) WHEN 'flat' THEN count(flat) = 16 AND min(flat) = max(flat) ELSE count(gap) = 16 AND coalesce(min(gap) = max(gap), false) END AS frozen
FROM b, (SELECT unnest(['high', 'flat', 'gap']) AS f) WHERE r <= 16 GROUP BY symbol, f"""
)
def frozen_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_daily(spark, sf_dir).select("symbol", "day", "high", F.floor(F.dayofyear("day") / 400).alias("flat"), F.when(F.col("symbol") != "A", 1).alias("gap"))
    f = ops.frozen(b, ["high", "flat", "gap"])
    return f.withColumn("frozen", F.coalesce("frozen", F.lit(False)))


@query(
    f"""WITH {MACRO}, o AS (SELECT series, count(*) AS rows, max(obs_date) AS last FROM macro GROUP BY series), r AS (SELECT DISTINCT series FROM macro UNION ALL SELECT '9-NONE')
SELECT r.series, coalesce(rows, 0) AS rows, last, CAST(DATE '1998-08-05' - last AS INTEGER) AS age_days,
  CASE WHEN last IS NULL THEN 'INSUFFICIENT_DATA' WHEN DATE '1998-08-05' < last THEN 'FUTURE_DATA' WHEN DATE '1998-08-05' - last > 7 THEN 'STALE_DATA' ELSE 'OK' END AS state FROM r LEFT JOIN o USING (series)"""
)
def freshness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = macro_observations(spark, sf_dir)
    required = m.select("series").union(spark.createDataFrame([("9-NONE",)], "series string"))
    return ops.freshness(m, required, F.lit("1998-08-05").cast("date"))


@query(
    """WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS close, CASE WHEN o_orderkey % 7 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice / 100 END AS x, CASE WHEN o_orderkey % 13 = 0 THEN 'inf'::DOUBLE ELSE 1 END AS y FROM orders)
SELECT id, concat_ws(',', CASE WHEN close IS NULL THEN 'close' END, CASE WHEN isnan(x) THEN 'x' END, CASE WHEN isinf(y) THEN 'y' END) AS missing FROM v WHERE close IS NULL OR isnan(x) OR isinf(y)"""
)
def dq_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a training set may not hold, with the columns that are missing or not finite."""
    k = F.col("o_orderkey")
    v = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 11 != 0, F.col("o_totalprice")).alias("close"), F.when(k % 7 == 0, float("nan")).otherwise(F.col("o_totalprice") / 100).alias("x"), F.when(k % 13 == 0, float("inf")).otherwise(1.0).alias("y")
    )
    names = ops.missing_names(v, ["close", "x", "y"])
    return v.select("id", names.alias("m")).where("size(m) > 0").select("id", F.array_join("m", ",").alias("missing"))


@query("SELECT c_custkey % 4 AS part, count(*) AS rows, sum(('0x' || substr(sha256(c_custkey || chr(31) || c_name || chr(31) || c_mktsegment), 1, 12))::BIGINT)::BIGINT AS checksum FROM customer GROUP BY 1".replace("SELECT c_custkey % 4 AS part", "SELECT c_custkey % 4 AS part"))
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and checksum of each part; a checksum is a sum modulo 2^64, so it is the SQL's as long as that one fits a BIGINT."""
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", "c_name", "c_mktsegment")
    m = ops.manifest(rows, ["c_custkey"])
    return m.groupBy((F.col("c_custkey") % 4).alias("part")).agg(F.sum("rows").alias("rows"), ops.wrapped_sum(F.col("checksum")).alias("checksum"))


@query(
    f"""WITH {BARS}, t AS (SELECT symbol, day, floor(extract('epoch' FROM day) / 86400 / 3)::BIGINT * 1000000 + (99999 - floor(extract('epoch' FROM day) / 86400)::BIGINT) AS pos FROM bars)
SELECT symbol, day FROM (SELECT *, lag(day) OVER (PARTITION BY symbol ORDER BY pos) AS before FROM t) WHERE day <= before"""
)
def date_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block of three days is stored backwards before the check."""
    n = F.unix_date("day").cast("long")
    b = bars_daily(spark, sf_dir).select("symbol", "day", (F.floor(n / 3) * 1000000 + (99999 - n)).alias("pos"))
    return ops.date_order(b, "pos").select("symbol", "day")


@query(
    f"""WITH {MACRO} SELECT series, obs_date, vintage, CAST(available_at AS DATE) < obs_date + 60 AS early FROM macro WHERE CAST(available_at AS DATE) < obs_date OR vintage = '' OR CAST(available_at AS DATE) < obs_date + 60"""
)
def availability_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.to_date("available_at") < F.date_add("obs_date", 60)
    m = macro_observations(spark, sf_dir)
    return m.where((F.to_date("available_at") < F.col("obs_date")) | (F.col("vintage") == "") | early).select("series", "obs_date", "vintage", early.alias("early"))


_FOLDS = f"""WITH {BARS}, {LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol, horizon) AS n FROM labels_ WHERE target_day IS NOT NULL),
f AS (SELECT r.*, fold, floor(n * a)::BIGINT AS start, CASE WHEN b < 1 THEN floor(n * b)::BIGINT ELSE n END AS stop FROM r, (VALUES (0, 0.55::DOUBLE, 0.70::DOUBLE), (1, 0.70::DOUBLE, 0.85::DOUBLE), (2, 0.85::DOUBLE, 1::DOUBLE)) AS q(fold, a, b)),
g AS (SELECT *, min(CASE WHEN i = start THEN day END) OVER (PARTITION BY symbol, horizon, fold) AS test_day FROM f),
u AS (SELECT *, i < start AND target_day < test_day AS usable FROM g),
m AS (SELECT *, sum(usable::INT) OVER (PARTITION BY symbol, horizon, fold) AS m, sum(usable::INT) OVER (PARTITION BY symbol, horizon, fold ORDER BY day) AS k FROM u),
t AS (SELECT *, usable AND k > m - greatest(30, floor(m * 0.2::DOUBLE)) AS in_tail FROM m),
v AS (SELECT *, min(CASE WHEN in_tail THEN day END) OVER (PARTITION BY symbol, horizon, fold) AS tail_day FROM t),
p AS (SELECT *, CASE WHEN i >= start AND i < stop THEN 'test' WHEN in_tail THEN 'calibrate' WHEN usable AND target_day < tail_day THEN 'train' WHEN i < start THEN 'purged' END AS part FROM v)"""


@query(f"{_FOLDS} SELECT symbol, horizon, CAST(fold AS INTEGER) AS fold, part, count(*) AS n, min(day) AS first, max(day) AS last FROM p WHERE part IS NOT NULL GROUP BY ALL")
def walk_forward_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.walk_forward(asof.forward_return(bars_daily(spark, sf_dir)))


_BASELINES = f"""WITH {BARS}, {LABELS}, k AS (SELECT * FROM labels_ WHERE target_day IS NOT NULL),
j AS (SELECT l.symbol, l.horizon, l.day, k.target_return AS t, row_number() OVER (PARTITION BY l.symbol, l.horizon, l.day ORDER BY k.target_day DESC, k.day DESC) AS r FROM labels_ l LEFT JOIN k ON k.symbol = l.symbol AND k.horizon = l.horizon AND k.target_day < l.day)
SELECT symbol, horizon, day, round(avg(t), 6) AS mean, round(avg(t) FILTER (WHERE r <= 126), 6) AS rolling, round(CASE WHEN avg((t > 0)::INT) >= 0.5 THEN median(abs(t)) ELSE -median(abs(t)) END, 6) AS majority FROM j GROUP BY symbol, horizon, day"""


@query(_BASELINES)
def rolling_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.rolling_baselines(asof.forward_return(bars_daily(spark, sf_dir))))


@query(_BASELINES)
def rolling_baselines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its earlier name."""
    return rolling_baselines(spark, sf_dir)


_TAIL = _FOLDS.replace("greatest(30, floor(m * 0.2::DOUBLE))", "126")


@query(
    f"""{_TAIL}, c AS (SELECT symbol, horizon, fold, count(*) FILTER (WHERE usable) AS history, count(*) FILTER (WHERE part = 'train') AS train, count(*) FILTER (WHERE part = 'calibrate') AS calibrate, count(*) FILTER (WHERE part = 'test') AS test FROM p GROUP BY 1, 2, 3)
SELECT symbol, horizon, CAST(fold AS INTEGER) AS fold, train, calibrate, test, CASE WHEN history < 250 THEN 'too little history' WHEN train < 100 THEN 'too little to train on' ELSE 'ok' END AS state FROM c"""
)
def research_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding folds with the last 126 matured rows for calibration; a fold needs 250 rows of history and 100 to train on."""
    f = ops.fold_rows(asof.forward_return(saved(bars_daily(spark, sf_dir))), calibration=0.0, least=126)
    # rows between the training rows and the calibration are history too, unless their target matured in the test
    n = lambda p: F.count_if(F.col("part") == p)
    test = F.min(F.when(F.col("part") == "test", F.col("day"))).over(Window.partitionBy("symbol", "horizon", "fold"))
    g = f.withColumn("test_day", test).groupBy("symbol", "horizon", "fold").agg(n("train").alias("train"), n("calibrate").alias("calibrate"), n("test").alias("test"), F.count_if((F.col("part") != "test") & (F.col("target_day") < F.col("test_day"))).alias("history"))
    state = F.when(F.col("history") < 250, "too little history").when(F.col("train") < 100, "too little to train on").otherwise("ok")
    return g.select("symbol", "horizon", "fold", "train", "calibrate", "test", state.alias("state"))


@query(
    f"""{_FOLDS}, c AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon, fold ORDER BY day) AS j, count(*) OVER (PARTITION BY symbol, horizon, fold) AS nc FROM p WHERE part = 'calibrate'),
l AS (SELECT *, j > greatest(1, floor(nc * 0.6::DOUBLE)) AS late FROM c), q AS (SELECT *, min(CASE WHEN late THEN day END) OVER (PARTITION BY symbol, horizon, fold) AS first FROM l),
us AS (SELECT *, CASE WHEN late THEN 'interval' WHEN target_day < first THEN 'weight' END AS use FROM q), z AS (SELECT symbol, horizon, CAST(fold AS INTEGER) AS fold, use, count(*) AS n, min(day) AS first, max(day) AS last FROM us WHERE use IS NOT NULL GROUP BY ALL)
SELECT z.* FROM z JOIN (SELECT symbol, horizon, fold FROM z WHERE n >= 10 GROUP BY ALL HAVING count(*) = 2) ok USING (symbol, horizon, fold)"""
)
def calibration_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ops.calibration_split(ops.fold_rows(asof.forward_return(saved(bars_daily(spark, sf_dir)))))
    return f.groupBy("symbol", "horizon", "fold", "use").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


_MILLIONTHS = " || ',' || ".join(f"CAST(round({c} * 1e6) AS BIGINT)" for c in ops.GOLD)


@query(
    f"""WITH {BARS}, {_GOLD_CTE}, gg AS (SELECT * FROM f WHERE n > 60), l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r, count(*) OVER (PARTITION BY symbol) AS m FROM gg),
z AS (SELECT symbol, list_filter([{", ".join(f"CASE WHEN count(DISTINCT {c}) FILTER (WHERE r <= 16) = 1 AND max(m) >= 16 THEN '{c}' END" for c in sorted(ops.GOLD))}], lambda x: x IS NOT NULL) AS still FROM l GROUP BY symbol)
SELECT l.symbol, day, round(close, 6) AS price, sha256({_MILLIONTHS}) AS fingerprint, array_to_string(still, ',') AS frozen FROM l JOIN z USING (symbol) WHERE r = 1"""
)
def latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = saved(gold_features(bars_daily(spark, sf_dir)))
    return ops.latest_vector(g, ops.GOLD, ops.frozen(g, list(ops.GOLD))).withColumn("price", F.round("price", 6))


_EXTRA = ("return_10", "return_40", "sma_distance_200")


@query(
    f"""WITH {BARS}, {_GOLD_CTE}, e AS (SELECT symbol, day, close / lag(close, 10) OVER w - 1 AS return_10, close / lag(close, 40) OVER w - 1 AS return_40, CASE WHEN row_number() OVER w > 200 THEN close / avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS 199 PRECEDING) - 1 END AS sma_distance_200 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)),
gg AS (SELECT f.*, return_10, return_40, sma_distance_200 FROM f JOIN e USING (symbol, day) WHERE n > 60), m AS (SELECT symbol, {", ".join(f"median({c}) FILTER (WHERE day < DATE '1996-01-01') AS m_{c}" for c in (*ops.GOLD, *_EXTRA))}, quantile_cont(volatility_20, 1.0 / 3) FILTER (WHERE day < DATE '1996-01-01') AS v1, quantile_cont(volatility_20, 2.0 / 3) FILTER (WHERE day < DATE '1996-01-01') AS v2 FROM gg GROUP BY symbol)
SELECT gg.symbol, day, {", ".join(f"round(coalesce({c}, m_{c}, 0), 6) AS {c}" for c in (*ops.GOLD, *_EXTRA))}, (volatility_20 < v1)::INT AS low_vol, (volatility_20 > v2)::INT AS high_vol, (ma50_distance > 0.02)::INT AS bull, (ma50_distance < -0.02)::INT AS bear FROM gg JOIN m USING (symbol)"""
)
def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest design: bar features, engineered ones and regime flags; unknown values and thresholds come from training rows alone."""
    b = saved(bars_daily(spark, sf_dir))
    w = Window.partitionBy("symbol").orderBy("day")
    c = F.col("close")
    e = b.select("symbol", "day", *((c / F.lag("close", k).over(w) - 1).alias(f"return_{k}") for k in (10, 40)), F.when(F.row_number().over(w) > 200, c / F.avg("close").over(w.rowsBetween(-199, 0)) - 1).alias("sma_distance_200"))
    g = saved(gold_features(b).join(e, ["symbol", "day"]))
    train, columns = F.col("day") < "1996-01-01", (*ops.GOLD, *_EXTRA)
    cuts = g.where(train).groupBy("symbol").agg(F.percentile("volatility_20", [1 / 3, 2 / 3]).alias("v"))
    d = ops.imputed(g, columns, train).join(cuts, "symbol")
    flags = {"low_vol": F.col("volatility_20") < F.col("v")[0], "high_vol": F.col("volatility_20") > F.col("v")[1], "bull": F.col("ma50_distance") > 0.02, "bear": F.col("ma50_distance") < -0.02}
    return all_rounded(d.select("symbol", "day", *columns, *(x.cast("int").alias(k) for k, x in flags.items())))
