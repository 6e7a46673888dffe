"""Queries over models: attribution, distributions, ensembles, and decisions to train or issue."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof
from ..operators import models as ops
from ..operators.features import GOLD
from ..operators.windows import gold_features
from ..sources.sinks import content_id
from ..sources.tables import BARS, FORECASTS, MACRO, bars_daily, forecasts, macro_observations, saved, table
from .evaluation import _PAIRS, _design, pairs
from .features import _GOLD_CTE
from .joins import LABELS
from .registry import query
from .windows import all_rounded

_WEIGHTS = {"return_20": 0.4, "rsi14": -0.2, "drawdown_60": 0.1}
_G = f"{BARS}, {_GOLD_CTE}, gold AS (SELECT * FROM f WHERE n > 60)"


@query(
    f"""WITH {_G}, m AS (SELECT avg(return_20) AS a, avg(rsi14) AS b, avg(drawdown_60) AS c FROM gold)
SELECT symbol, day, unnest(['return_20', 'rsi14', 'drawdown_60']) AS feature, unnest([round(0.4 * (return_20 - a), 6), round(-0.2 * (rsi14 - b), 6), round(0.1 * (drawdown_60 - c), 6)]) AS effect FROM gold, m"""
)
def feature_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.effects(gold_features(bars_daily(spark, sf_dir)), _WEIGHTS, ["symbol", "day"]))


@query(
    f"WITH {_G} SELECT symbol, day, CAST("
    + " + ".join(f"(abs(({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w < 1e-9 THEN 1 ELSE stddev_pop({c}) OVER w END) > 3)::INT" for c in GOLD)
    + " AS INTEGER) AS n_outside FROM gold WINDOW w AS (PARTITION BY symbol)"
)
def out_of_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.outside(gold_features(bars_daily(spark, sf_dir)), GOLD, ["symbol"]).select("symbol", "day", "n_outside")


@query()
def mahalanobis_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = saved(gold_features(bars_daily(spark, sf_dir)))
    return all_rounded(ops.mahalanobis(x.where("day < DATE '1996-01-01'"), x.where("day >= DATE '1996-01-01'"), GOLD, ["symbol"], ["symbol", "day"]), 4)


#: An ensemble of three members over three features, with its scaler.
_SERVED = ("return_20", "rsi14", "volatility_20")
_SCALER = ([0.0, 0.0, 10.0], [0.25, 0.2, 2.5])
_MEMBERS = (([0.010, -0.020, 0.005], 0.001), ([0.020, -0.010, 0.000], 0.000), ([0.015, 0.005, -0.005], -0.001))
_Z = [f"least(6, greatest(-6, ({c} - {m}) / {s}))" for c, m, s in zip(_SERVED, *_SCALER, strict=True)]
_TOLD = ", ".join(f"({' + '.join(f'{w}::DOUBLE * {z}' for w, z in zip(ws, _Z, strict=True))} + {b})" for ws, b in _MEMBERS)


@query(
    f"""WITH {_G}, t AS (SELECT *, [{_TOLD}] AS told FROM gold), m AS (SELECT *, list_avg(told) AS a, list_stddev_pop(told) AS d FROM t)
SELECT symbol, day, round(0.4 * a, 6) AS mean, round(0.4 * d, 6) AS disagreement, round(0.03 * least(greatest(volatility_20 / 10.0, 0.75), 2), 6) AS error, round(close * (1 + 0.4 * a), 4) AS price,
  array_to_string(list_filter([{", ".join(f"CASE WHEN abs(({c} - {m}) / {s}) > 6 THEN '{c}' END" for c, m, s in zip(_SERVED, *_SCALER, strict=True))}], lambda x: x IS NOT NULL), ',') AS clipped,
  CASE WHEN {" OR ".join(f"abs(({c} - {m}) / {s}) > 6" for c, m, s in zip(_SERVED, *_SCALER, strict=True))} THEN 'OUT_OF_DISTRIBUTION' ELSE 'OK' END AS status FROM m"""
)
def served_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold_features(bars_daily(spark, sf_dir))
    s = ops.serve(g, _SERVED, *_SCALER, _MEMBERS, 0.4, 0.03, 10.0)
    return all_rounded(s.withColumn("price", F.round("price", 4)))


@query()
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum, zero and mean forecasts of each symbol and horizon."""
    p = pairs(spark, sf_dir)
    mean = F.avg("actual").over(Window.partitionBy("symbol", "horizon"))
    e = p.select("symbol", "horizon", (F.col("pred") - F.col("actual")).alias("momentum"), (-F.col("actual")).alias("zero"), (mean - F.col("actual")).alias("mean"))
    return ops.ensemble_weights(e, ["momentum", "zero", "mean"], ["symbol", "horizon"])


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"x_{c}" for c in GOLD]

    def importance(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day")
        x = rows[names].to_numpy()
        w = np.linalg.solve(x.T @ x + 0.01 * len(x) * np.eye(len(names)), x.T @ rows["actual"].to_numpy())
        out = ops.permutation_importance(rows, names, w)
        return out.assign(symbol=rows["symbol"].iloc[0], horizon=rows["horizon"].iloc[0])[["symbol", "horizon", "feature", "importance"]]

    return _design(spark, sf_dir).groupBy("symbol", "horizon").applyInPandas(importance, "symbol string, horizon int, feature string, importance double")


@query(
    f"""WITH {BARS}, {_PAIRS}, b AS (SELECT symbol, horizon, ntile(8) OVER (PARTITION BY symbol, horizon ORDER BY pred, day) AS i, ntile(8) OVER (PARTITION BY symbol, horizon ORDER BY actual, day) AS j FROM pairs),
q AS (SELECT symbol, horizon, i, j, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY symbol, horizon, i) AS ni, sum(n) OVER (PARTITION BY symbol, horizon, j) AS nj, sum(n) OVER (PARTITION BY symbol, horizon) AS t FROM q)
SELECT symbol, horizon, round(sum(n::DOUBLE / t * ln(n::DOUBLE * t / (ni * nj))), 6) AS information FROM t GROUP BY symbol, horizon"""
)
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.mutual_information(pairs(spark, sf_dir), "pred", "actual", ["symbol", "horizon"]))


@query(
    f"""WITH {BARS}, {LABELS}, q AS (SELECT symbol, horizon, quantile_cont(target_return, 0.01) AS lo, quantile_cont(target_return, 0.99) AS hi FROM labels_ WHERE target_day < DATE '1996-01-01' GROUP BY 1, 2)
SELECT l.symbol, l.horizon, day, round(least(greatest(target_return, lo), hi), 6) AS target, round(ln(1 + target_return), 6) AS log_target FROM labels_ l JOIN q ON q.symbol = l.symbol AND q.horizon = l.horizon WHERE target_return IS NOT NULL"""
)
def target_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets clipped at the 1 and 99 % points of what had matured before 1996, the training rows, and their logarithms."""
    l = asof.forward_return(bars_daily(spark, sf_dir)).where("target_return IS NOT NULL")
    q = l.where("target_day < DATE '1996-01-01'").groupBy("symbol", "horizon").agg(F.percentile("target_return", [0.01, 0.99]).alias("q"))
    j = l.join(q, ["symbol", "horizon"])
    return all_rounded(j.select("symbol", "horizon", "day", F.least(F.greatest("target_return", F.col("q")[0]), F.col("q")[1]).alias("target"), F.log1p("target_return").alias("log_target")))


@query(f"WITH {BARS}, {LABELS}, n AS (SELECT symbol, horizon, count(*) FILTER (WHERE target_day > DATE '1998-01-01' AND target_return IS NOT NULL) AS matured FROM labels_ GROUP BY 1, 2) SELECT symbol, min(matured) AS least_matured, min(matured) >= 60 AS retrain FROM n GROUP BY symbol")
def retrain_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels matured since the last training, the least over horizons."""
    l = asof.forward_return(bars_daily(spark, sf_dir))
    n = l.groupBy("symbol", "horizon").agg(F.count(F.when((F.col("target_day") > "1998-01-01") & F.col("target_return").isNotNull(), 1)).alias("matured"))
    return n.groupBy("symbol").agg(F.min("matured").alias("least_matured"), (F.min("matured") >= 60).alias("retrain"))


@query(
    f"""WITH {BARS}, {LABELS}, s AS (SELECT symbol, day, horizon, target_return, CASE WHEN dayofmonth(day) = 1 THEN target_return + 0.01 ELSE target_return END AS stored FROM labels_ WHERE target_return IS NOT NULL)
SELECT symbol, day, horizon FROM s WHERE abs(stored - target_return) > 1e-10"""
)
def target_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored targets (those of the first of a month are spoiled) against recomputed ones."""
    l = asof.forward_return(bars_daily(spark, sf_dir)).where("target_return IS NOT NULL")
    stored = l.select("symbol", "day", "horizon", F.when(F.dayofmonth("day") == 1, F.col("target_return") + 0.01).otherwise(F.col("target_return")).alias("stored"))
    return l.join(stored, ["symbol", "day", "horizon"]).where("abs(stored - target_return) > 1e-10").select("symbol", "day", "horizon")


@query(
    f"""WITH {FORECASTS} SELECT id, instrument, horizon, origin, origin + horizon AS due FROM forecasts WHERE p10 <= p50 AND p50 <= p90 AND base > 0 AND origin >= DATE '1995-01-01' AND issued_at < 900"""
)
def canonical_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts that may be issued: ordered quantiles, a positive base, not before the ledger's start, not late."""
    f = forecasts(spark, sf_dir)
    ok = (F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90")) & (F.col("base") > 0) & (F.col("origin") >= "1995-01-01") & (F.col("issued_at") < 900)
    return f.where(ok).select("id", "instrument", "horizon", "origin", F.date_add("origin", F.col("horizon")).alias("due"))


@query("SELECT o_orderstatus AS instrument, count(DISTINCT (o_orderstatus, o_orderdate, o_orderpriority)) AS n FROM orders GROUP BY o_orderstatus")
def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with equal contents have one identity."""
    o = table(spark, sf_dir, "orders").withColumn("id", content_id("o_orderstatus", "o_orderdate", "o_orderpriority"))
    return o.groupBy(F.col("o_orderstatus").alias("instrument")).agg(F.count_distinct("id").alias("n"))


@query(
    f"""WITH {MACRO}, o AS (SELECT series, obs_date, value, row_number() OVER w AS n, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2, lag(value, 12) OVER w AS v12 FROM macro WHERE vintage = 'initial' WINDOW w AS (PARTITION BY series ORDER BY obs_date))
SELECT series, obs_date, round(value / v1 - 1, 6) AS mom, round(v1 / v2 - 1, 6) AS mom_before, round(value / v12 - 1, 6) AS yoy FROM o WHERE n >= 14"""
)
def inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month on month, the one before, and year on year by twelve observations; from the 14th on."""
    w = Window.partitionBy("series").orderBy("obs_date")
    v = F.col("value")
    o = macro_observations(spark, sf_dir).where("vintage = 'initial'").withColumn("n", F.row_number().over(w))
    o = o.select("series", "obs_date", "n", (v / F.lag("value", 1).over(w) - 1).alias("mom"), (F.lag("value", 1).over(w) / F.lag("value", 2).over(w) - 1).alias("mom_before"), (v / F.lag("value", 12).over(w) - 1).alias("yoy"))
    return all_rounded(o.where("n >= 14").drop("n"))


@query(
    f"""WITH {BARS}, l AS (SELECT symbol, max(day) AS last FROM bars GROUP BY symbol), x AS (SELECT b.symbol, b.day, b.volume, l.last FROM bars b JOIN l ON l.symbol = b.symbol WHERE b.day > l.last - 1095),
v AS (SELECT symbol, arg_max(volume, day) AS now, arg_max(volume, day) FILTER (WHERE day <= last - 7) AS before FROM x GROUP BY symbol)
SELECT x.symbol, round(avg((volume < now)::INT), 6) AS percentile, any_value(now - before) AS weekly_change FROM x JOIN v ON v.symbol = x.symbol WHERE x.day < x.last GROUP BY x.symbol"""
)
def positioning_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the last three years' values below the last one, and its change in a week."""
    b = bars_daily(spark, sf_dir).select("symbol", "day", "volume")
    x = b.join(b.groupBy("symbol").agg(F.max("day").alias("last")), "symbol").where(F.col("day") > F.date_sub("last", 1095))
    v = x.groupBy("symbol").agg(F.max_by("volume", "day").alias("now"), F.max_by("volume", F.when(F.col("day") <= F.date_sub("last", 7), F.col("day"))).alias("before"))
    p = x.where("day < last").join(v, "symbol").groupBy("symbol").agg(F.avg((F.col("volume") < F.col("now")).cast("double")).alias("percentile"), F.first(F.col("now") - F.col("before")).alias("weekly_change"))
    return all_rounded(p)


@query(
    """WITH v AS (SELECT c_mktsegment AS topic, CASE WHEN c_acctbal > 6000 THEN 'up' WHEN c_acctbal < 1500 THEN 'down' ELSE 'flat' END AS side, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT topic, sum(n)::BIGINT AS votes, CASE WHEN max(n) * 2 > sum(n) THEN arg_max(side, (n, side)) ELSE 'mixed' END AS dominant FROM v GROUP BY topic"""
)
def vote_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side with more than half of the votes, else mixed."""
    side = F.when(F.col("c_acctbal") > 6000, "up").when(F.col("c_acctbal") < 1500, "down").otherwise("flat")
    v = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("topic"), side.alias("side")).agg(F.count("*").alias("n"))
    top = F.max_by("side", F.struct("n", "side"))
    return v.groupBy("topic").agg(F.sum("n").alias("votes"), F.when(F.max("n") * 2 > F.sum("n"), top).otherwise("mixed").alias("dominant"))


@query(
    """WITH i AS (SELECT s_suppkey AS id, s_nationkey AS grp, s_acctbal / 100 AS usd FROM supplier WHERE abs(s_acctbal / 100) >= 1)
SELECT id, grp, round(usd, 6) AS usd, round(abs(usd) / max(abs(usd)) OVER (PARTITION BY grp), 6) AS share, round(sum(CASE WHEN usd > 0 THEN usd ELSE 0 END) OVER (PARTITION BY grp), 6) AS up, round(sum(CASE WHEN usd < 0 THEN usd ELSE 0 END) OVER (PARTITION BY grp), 6) AS down FROM i"""
)
def impact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impacts of a dollar and more, beside the largest and the sums of their group."""
    w = Window.partitionBy("grp")
    i = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("grp"), (F.col("s_acctbal") / 100).alias("usd")).where("abs(usd) >= 1")
    usd = F.col("usd")
    return all_rounded(i.withColumns({"share": F.abs(usd) / F.max(F.abs(usd)).over(w), "up": F.sum(F.when(usd > 0, usd).otherwise(0.0)).over(w), "down": F.sum(F.when(usd < 0, usd).otherwise(0.0)).over(w)}))


@query("SELECT grp, rank::INT AS rank, id, round(usd, 6) AS usd FROM (SELECT s_nationkey AS grp, s_suppkey AS id, s_acctbal / 100 AS usd, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal / 100) DESC, s_suppkey) AS rank FROM supplier WHERE abs(s_acctbal / 100) >= 1) WHERE rank <= 3")
def top_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest impacts of each group, up or down."""
    i = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("usd")).where("abs(usd) >= 1")
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.abs("usd")), "id"))
    return all_rounded(i.withColumn("rank", rank).where("rank <= 3").select("grp", "rank", "id", "usd"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_retailprice WHEN p_size % 3 = 1 THEN p_retailprice * 1.01::DOUBLE ELSE p_size * 50.0::DOUBLE END AS price, CASE p_size % 3 WHEN 0 THEN 'spot' WHEN 1 THEN 'token' ELSE 'futures' END AS source FROM part")
def live_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known of spot, token and futures times basis."""
    p = table(spark, sf_dir, "part")
    spot = F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice"))
    token = F.when(F.col("p_size") % 3 <= 1, F.col("p_retailprice") * 1.01)
    futures = F.col("p_size") * 50.0
    source = F.when(spot.isNotNull(), "spot").when(token.isNotNull(), "token").otherwise("futures")
    return p.select(F.col("p_partkey").alias("id"), F.coalesce(spot, token, futures).alias("price"), source.alias("source"))


@query(
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, md5(string_agg(event_type, ',' ORDER BY event_id)) AS h FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(h) OVER w AS before, lag(day) OVER w AS last FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, CASE WHEN before IS NULL THEN 'first' WHEN day - last > 2 THEN 'stale' WHEN h <> before AND n >= 3 THEN 'changed' ELSE 'fast' END AS plan FROM l"""
)
def run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full run on the first day, after a gap, or when enough inputs have changed; a fast one otherwise."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    d = e.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.md5(F.array_join(names, ",")).alias("h"))
    w = Window.partitionBy("user_id").orderBy("day")
    d = d.withColumns({"before": F.lag("h").over(w), "last": F.lag("day").over(w)})
    plan = F.when(F.col("before").isNull(), "first").when(F.datediff("day", "last") > 2, "stale").when((F.col("h") != F.col("before")) & (F.col("n") >= 3), "changed").otherwise("fast")
    return d.select("user_id", "day", plan.alias("plan"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used, 5 - count(*) AS budget_left, count(*) >= 5 AS exhausted, max(ts) FILTER (WHERE event_type = 'error') AS last_error FROM events GROUP BY 1, 2")
def quota_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a day against a budget of five, and the last failure that starts a pause."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"), (5 - F.count("*")).alias("budget_left"), (F.count("*") >= 5).alias("exhausted"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("last_error"))


@query(f"WITH {MACRO} SELECT series, max(obs_date) AS obs_date, count(*) AS n FROM macro WHERE available_at <= TIMESTAMP '1996-01-01' GROUP BY series")
def known_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = macro_observations(spark, sf_dir).where(F.col("available_at") <= F.lit("1996-01-01").cast("timestamp"))
    return m.groupBy("series").agg(F.max("obs_date").alias("obs_date"), F.count("*").alias("n"))


@query(
    "SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal / 100 END, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::DOUBLE END, c_acctbal) AS a, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 7::DOUBLE END, 1::DOUBLE) AS b FROM customer"
)
def feature_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User values over live ones over the latest ones."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    latest = F.create_map(F.lit("a"), F.col("c_acctbal"), F.lit("b"), F.lit(1.0))
    live = F.when(k % 3 == 0, F.create_map(F.lit("a"), F.col("c_nationkey").cast("double"), F.lit("b"), F.lit(7.0)))
    user = F.when(k % 5 == 0, F.create_map(F.lit("a"), F.col("c_acctbal") / 100))
    of = lambda name: F.coalesce(*(m[name] for m in (user, live, latest))).alias(name)
    return c.select(k.alias("id"), of("a"), of("b"))
