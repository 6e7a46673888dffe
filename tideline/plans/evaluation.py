"""Queries that evaluate forecasts and keep their ledger."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fits
from ..functions.kernels import adaptive_widths, neighbour_information
from ..operators import asof
from ..operators import evaluate as ops
from ..sources.tables import BARS, FORECASTS, bars_daily, dealt, forecasts, saved
from .bars import rounded
from .features import _FOLDS, _GOLD_CTE
from .joins import LABELS
from .registry import SQL, query
from .windows import all_rounded

_PAIRS = f"""{LABELS}, mom AS (SELECT symbol, day, close AS price, close / lag(close, 28) OVER (PARTITION BY symbol ORDER BY day) - 1 AS m FROM bars),
pairs AS (SELECT l.symbol, l.horizon, l.day, l.target_day, l.target_return AS actual, m * l.horizon / 28 AS pred, m, price FROM labels_ l JOIN mom ON mom.symbol = l.symbol AND mom.day = l.day WHERE target_return IS NOT NULL AND m IS NOT NULL)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum forecasts against what happened, and the price at which they were made."""
    from ..operators.features import momentum_labels

    b = saved(bars_daily(spark, sf_dir))
    m = momentum_labels(b).where("momentum IS NOT NULL").join(b.select("symbol", "day", F.col("close").alias("price")), ["symbol", "day"])
    l = asof.forward_return(b).where("target_return IS NOT NULL")
    return l.join(m, ["symbol", "day"]).select("symbol", "horizon", "day", "target_day", F.col("target_return").alias("actual"), (F.col("momentum") * F.col("horizon") / 28).alias("pred"), F.col("momentum").alias("m"), "price")


@query(
    f"""WITH {BARS}, {_PAIRS}, x AS (SELECT *, abs(pred) > 1e-12 AS act, (sign(pred) = sign(actual))::INT AS same, pred - actual AS e FROM pairs)
SELECT symbol, horizon, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e ** 2)), 6) AS rmse, round(quantile_cont(abs(e), 0.5), 6) AS median_ae, round(avg(e), 6) AS bias,
  round(avg(same) FILTER (WHERE act AND actual <> 0), 6) AS direction, round(avg(same), 6) AS direction_all, round((avg((pred > 0)::INT) FILTER (WHERE act AND actual > 0) + avg((pred < 0)::INT) FILTER (WHERE act AND actual < 0)) / 2, 6) AS balanced_direction,
  round(avg(same) FILTER (WHERE act), 6) AS active_direction, round(avg(act::INT), 6) AS active_fraction, round(corr(pred, actual), 6) AS correlation, round(1 - avg(e ** 2) / nullif(var_pop(actual), 0), 6) AS r2, round(CASE WHEN regr_sxx(actual, pred) > 1e-18 THEN regr_slope(actual, pred) END, 6) AS slope,
  round(1 - avg(abs(e)) / nullif(avg(abs(actual)), 0), 6) AS skill_mae, round(1 - avg(e ** 2) / nullif(avg(actual * actual), 0), 6) AS skill_mse, round(avg(abs(e) * price), 4) AS price_mae, round(avg((abs(e) * price <= 2)::INT), 6) AS within_2, round(avg((actual > 0)::INT), 6) AS always_up FROM x GROUP BY symbol, horizon"""
)
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ops.metrics(pairs(spark, sf_dir), ["symbol", "horizon"])
    return rounded(all_rounded(m.withColumn("price_mae", F.round("price_mae", 4))), "price_mae", digits=4)


@query(
    f"""WITH {BARS}, {_PAIRS}, x AS (SELECT symbol, horizon, actual, CASE WHEN dayofyear(day) % 4 = 0 THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS weight, pred FROM pairs), y AS (SELECT *, weight * pred AS p FROM x),
z AS (SELECT *, weight >= 0.2 AS act, weight >= 0.2 AND abs(actual) > 1e-12 AND abs(p) > 1e-12 AS dir FROM y)
SELECT symbol, horizon, count(*) AS n, round(avg(abs(actual - p)), 6) AS mae, round(sqrt(avg((actual - p) ** 2)), 6) AS rmse, round(avg(p - actual), 6) AS bias, round(avg(((actual > 0) = (p > 0))::INT) FILTER (WHERE dir), 6) AS direction, count(*) FILTER (WHERE dir) AS directional_rows, round(avg(act::INT), 6) AS active_fraction,
  round(avg(abs(actual)), 6) AS mae_zero, round(sqrt(avg(actual ** 2)), 6) AS rmse_zero, round(1 - avg(abs(actual - p)) / nullif(avg(abs(actual)), 0), 6) AS skill_mae, round(1 - avg((actual - p) ** 2) / nullif(avg(actual ** 2), 0), 6) AS skill_mse, round(avg((abs(actual - p) <= 0.02)::INT), 6) AS within_2pp FROM z GROUP BY symbol, horizon"""
)
def served_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.when(F.dayofyear("day") % 4 == 0, 0.1).otherwise(0.5)
    p = pairs(spark, sf_dir).withColumn("weight", w).withColumn("pred", F.col("weight") * F.col("pred"))
    return all_rounded(ops.served_metrics(p, ["symbol", "horizon"]))


@query(
    f"""WITH {BARS}, {_PAIRS}, s AS (SELECT symbol, horizon, CASE WHEN regr_sxx(actual, pred) < 1e-18 THEN 0 ELSE least(greatest(regr_slope(actual, pred), 0), 1) END AS w FROM pairs GROUP BY 1, 2)
SELECT symbol, horizon, CASE WHEN avg((w * pred - actual) ** 2) < avg(actual * actual) THEN round(any_value(w), 6) ELSE 0::DOUBLE END AS weight FROM pairs JOIN s USING (symbol, horizon) GROUP BY symbol, horizon"""
)
def shrinkage_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.shrinkage(pairs(spark, sf_dir), ["symbol", "horizon"]))


_CONFORMAL = "c AS (SELECT symbol, horizon, n, width FROM (SELECT symbol, horizon, abs(pred - actual) AS width, row_number() OVER (PARTITION BY symbol, horizon ORDER BY abs(pred - actual)) AS r, count(*) OVER (PARTITION BY symbol, horizon) AS n FROM pairs WHERE day < DATE '1996-01-01') WHERE r = least(n, ceil((n + 1) * 0.8::DOUBLE)))"


def _widths(p: DataFrame) -> DataFrame:
    return ops.conformal(p.where("day < DATE '1996-01-01'").withColumn("score", F.abs(F.col("pred") - F.col("actual"))), ["symbol", "horizon"], 0.8)


@query(f"WITH {BARS}, {_PAIRS}, {_CONFORMAL} SELECT symbol, horizon, n, round(width, 6) AS width FROM c")
def conformal_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(_widths(pairs(spark, sf_dir)))


@query(
    f"""WITH {BARS}, {_PAIRS}, {_CONFORMAL} SELECT symbol, horizon, round(avg((abs(pred - actual) <= width)::INT), 6) AS covered, round(avg(2 * width), 6) AS mean_width,
  round(avg(2 * width + 10 * greatest(abs(pred - actual) - width, 0)), 6) AS interval_score FROM pairs JOIN c USING (symbol, horizon) WHERE day >= DATE '1996-01-01' GROUP BY symbol, horizon"""
)
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    errors = p.where("day >= DATE '1996-01-01'").withColumn("error", F.col("pred") - F.col("actual"))
    return all_rounded(ops.coverage(errors, _widths(p).drop("n"), ["symbol", "horizon"], 0.8))


@query(
    f"""WITH {BARS}, {_PAIRS}, t AS (SELECT quantile_cont(m, 1.0 / 3) AS c1, quantile_cont(m, 2.0 / 3) AS c2 FROM pairs WHERE day < DATE '1996-01-01'),
r AS (SELECT pairs.*, CASE WHEN m <= c1 THEN 'low' WHEN m <= c2 THEN 'middle' ELSE 'high' END AS regime FROM pairs, t WHERE day >= DATE '1996-01-01')
SELECT regime, horizon, count(*) AS n, round(avg(abs(pred - actual)), 6) AS mae, round(avg(pred - actual), 6) AS bias FROM r GROUP BY regime, horizon"""
)
def regime_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirds of momentum with thresholds of the training rows only."""
    p = pairs(spark, sf_dir)
    q = p.where("day < DATE '1996-01-01'").agg(F.percentile("m", [1 / 3, 2 / 3]).alias("q")).select(F.col("q")[0].alias("c1"), F.col("q")[1].alias("c2"))
    e = F.col("pred") - F.col("actual")
    r = ops.regimes(p.where("day >= DATE '1996-01-01'"), "m", q)
    return all_rounded(r.groupBy("regime", "horizon").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias")))


@query(
    f"""WITH {BARS}, {LABELS} SELECT symbol, horizon, count(target_return) AS n, round(avg(target_return), 6) AS mean, round(quantile_cont(target_return, 0.5), 6) AS median, round(stddev_pop(target_return), 6) AS sd, round((avg(target_return ** 3) - 3 * avg(target_return) * avg(target_return ** 2) + 2 * avg(target_return) ** 3) / stddev_pop(target_return) ** 3, 6) AS skew, round(kurtosis_pop(target_return), 6) AS kurtosis,
  round(quantile_cont(target_return, 0.05), 6) AS q05, round(quantile_cont(target_return, 0.25), 6) AS q25, round(quantile_cont(target_return, 0.75), 6) AS q75, round(quantile_cont(target_return, 0.95), 6) AS q95,
  round(min(target_return), 6) AS min, round(max(target_return), 6) AS max, round(avg((abs(target_return) > 0.5)::INT), 6) AS tail FROM labels_ GROUP BY symbol, horizon"""
)
def target_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.distribution(asof.forward_return(bars_daily(spark, sf_dir)), ["symbol", "horizon"], "target_return", 0.5))


@query(
    f"""WITH {BARS}, {_PAIRS}, r AS (SELECT *, rank() OVER (PARTITION BY symbol, horizon ORDER BY pred) + (count(*) OVER (PARTITION BY symbol, horizon, pred) - 1) / 2.0 AS rp,
  rank() OVER (PARTITION BY symbol, horizon ORDER BY actual) + (count(*) OVER (PARTITION BY symbol, horizon, actual) - 1) / 2.0 AS ra FROM pairs)
SELECT symbol, horizon, round(corr(pred, actual), 6) AS pearson, round(corr(rp, ra), 6) AS spearman FROM r GROUP BY symbol, horizon"""
)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.spearman(pairs(spark, sf_dir), ["symbol", "horizon"], "pred", "actual"))


_FEATURES = ("return_1", "return_5", "return_20", "ma50_distance", "rsi14", "atr14", "volatility_20", "drawdown_60")


@query(
    f"""WITH {BARS}, {_GOLD_CTE}, lg AS (SELECT symbol, day, unnest([{", ".join(f"'{c}'" for c in _FEATURES)}]) AS c, unnest([{", ".join(_FEATURES)}]) AS v, unnest(generate_series(1, {len(_FEATURES)})) AS k FROM f WHERE n > 60),
rk AS (SELECT *, rank() OVER (PARTITION BY symbol, c ORDER BY v) + (count(*) OVER (PARTITION BY symbol, c, v) - 1) / 2.0::DOUBLE AS r FROM lg)
SELECT x.symbol, x.c AS a, y.c AS b, count(*) AS n, round(corr(x.v, y.v), 6) AS pearson, round(corr(x.r, y.r), 6) AS spearman FROM rk x JOIN rk y ON x.symbol = y.symbol AND x.day = y.day AND x.k < y.k GROUP BY 1, 2, 3"""
)
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of bar features of each symbol, by values and by ranks."""
    from ..operators.windows import gold_features

    return all_rounded(ops.correlations(gold_features(bars_daily(spark, sf_dir)), list(_FEATURES), ["symbol"], ["day"]))


@query()
def feature_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of each bar feature with the target by nearest neighbours, on the earlier half of the labelled rows."""
    d = _design(spark, sf_dir)
    w = Window.partitionBy("symbol", "horizon")
    early = d.withColumns({"i": F.row_number().over(w.orderBy("day")), "of": F.count("*").over(w)}).where("i <= of div 2")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"x_{c}").alias("x")) for c in _FEATURES)))
    long = early.select("symbol", "horizon", F.col("actual").alias("y"), each.alias("f")).select("symbol", "horizon", "f.feature", "f.x", "y").where("x IS NOT NULL AND NOT isnan(x)")

    def information(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[0]
        return pd.DataFrame([(one.symbol, one.horizon, one.feature, len(rows), neighbour_information(rows["x"].to_numpy(), rows["y"].to_numpy()))], columns=["symbol", "horizon", "feature", "n", "information"])

    keys = ("symbol", "horizon", "feature")
    return all_rounded(dealt(long, *keys).groupBy(*keys).applyInPandas(information, "symbol string, horizon int, feature string, n long, information double"))


@query(
    f"WITH {BARS}, {LABELS} SELECT horizon, CAST(greatest(0, least(41, floor((target_return + 0.2) / 0.011) + 1)) AS BIGINT) AS bin, count(*) AS n FROM labels_ WHERE target_return IS NOT NULL GROUP BY 1, 2"
)
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty bins from -0.2 to 0.24; 0 and 41 take what lies outside."""
    l = asof.forward_return(bars_daily(spark, sf_dir)).where("target_return IS NOT NULL")
    b = F.greatest(F.lit(0), F.least(F.lit(41), F.floor((F.col("target_return") + 0.2) / 0.011) + 1)).cast("long")
    return l.groupBy("horizon", b.alias("bin")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {BARS}, {_PAIRS} SELECT symbol, day, horizon, round(abs(pred - actual), 6) AS error FROM pairs ORDER BY abs(pred - actual) DESC, symbol, day, horizon LIMIT 20"""
)
def largest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).withColumn("error", F.abs(F.col("pred") - F.col("actual")))
    return all_rounded(p.orderBy(F.desc("error"), "symbol", "day", "horizon").limit(20).select("symbol", "day", "horizon", "error"))


@query(
    f"""WITH {BARS}, {_PAIRS}, x AS (SELECT symbol, horizon, day, abs(pred - actual) AS e, abs(actual) AS y, (abs(pred) > 1e-12 AND actual <> 0)::INT AS v, (abs(pred) > 1e-12 AND actual <> 0 AND sign(pred) = sign(actual))::INT AS h FROM pairs),
c AS (SELECT symbol, horizon, count(*) OVER w AS i, sum(e) OVER w AS e, sum(y) OVER w AS y, sum(v) OVER w AS v, sum(h) OVER w AS h FROM x WINDOW w AS (PARTITION BY symbol, horizon ORDER BY day)),
n AS (SELECT symbol, horizon, count(*) AS n, least(30, count(*)) AS b FROM x GROUP BY 1, 2), c0 AS (SELECT * FROM c UNION ALL SELECT symbol, horizon, 0, 0, 0, 0, 0 FROM n),
d AS (SELECT *, unnest(generate_series(1, CAST(ceil(n / b) AS BIGINT))) AS k FROM (SELECT *, unnest(generate_series(1, 500)) AS rep FROM n)),
f AS (SELECT *, ('0x' || substr(md5('104-' || rep || '-' || k), 1, 8))::BIGINT % (n - b + 1) AS first FROM d), g AS (SELECT *, first + least(b, n - (k - 1) * b) AS stop FROM f),
s AS (SELECT g.symbol, g.horizon, n, rep, sum(z.e - a.e) AS e, sum(z.y - a.y) AS y, sum(z.v - a.v) AS v, sum(z.h - a.h) AS h FROM g JOIN c0 a ON a.symbol = g.symbol AND a.horizon = g.horizon AND a.i = first JOIN c0 z ON z.symbol = g.symbol AND z.horizon = g.horizon AND z.i = stop GROUP BY ALL),
r AS (SELECT symbol, horizon, n, e / n AS mae, CASE WHEN v > 0 THEN h / v END AS direction, CASE WHEN y > 0 THEN 1 - e / y END AS skill FROM s)
SELECT symbol, horizon, CAST(n AS INTEGER) AS n, {", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{k}" for c in ("mae", "direction", "skill") for k, q in (("low", 0.025), ("high", 0.975)))} FROM r GROUP BY symbol, horizon, n"""
)
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rounded(ops.block_bootstrap(pairs(spark, sf_dir), ("symbol", "horizon")))


_FIRST = """first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument, version, horizon, origin ORDER BY issued_at, id) AS k FROM forecasts) WHERE k = 1),
ranked AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY instrument, version, horizon ORDER BY origin DESC) AS rank FROM first_) WHERE rank <= 180)"""


@query(f"WITH {FORECASTS}, {_FIRST} SELECT id, instrument, version, horizon, origin, CAST(rank AS INTEGER) AS rank FROM ranked")
def ledger_first_issuance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_issuance(forecasts(spark, sf_dir)).select("id", "instrument", "version", "horizon", "origin", "rank")


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked forecasts with the price of their due day: base moved as the instrument N moved."""
    f = ops.first_issuance(forecasts(spark, sf_dir)).withColumns({"due": F.date_add("origin", F.col("horizon")), "symbol": F.lit("N")})
    n = bars_daily(spark, sf_dir).where("symbol = 'N'").select("symbol", F.col("day").alias("due"), F.col("close").alias("c"))
    a = asof.forward(f.select("symbol", F.col("origin").alias("due")), n.withColumnRenamed("c", "c0"), ["symbol"], "due", "c0").select(F.col("due").alias("origin"), "c0")
    b = asof.forward(f.select("symbol", "due"), n.withColumnRenamed("c", "c1"), ["symbol"], "due", "c1").select("due", "c1")
    return f.join(a, "origin", "left").join(b, "due", "left").withColumn("price", F.col("base") * (1 + (F.col("c1") / F.col("c0") - 1) / 20)).drop("c0", "c1")


_SETTLED = f"""{_FIRST}, nb AS (SELECT day, close FROM bars WHERE symbol = 'N'), s0 AS (SELECT r.*, nb.close AS c0 FROM ranked r ASOF LEFT JOIN nb ON r.origin <= nb.day),
settled AS (SELECT s0.*, base * (1 + (nb.close / c0 - 1) / 20) AS price FROM s0 ASOF LEFT JOIN nb ON s0.origin + s0.horizon <= nb.day)"""


@query(
    f"""WITH {FORECASTS}, {BARS}, {_SETTLED}, x AS (SELECT *, p50 / base - 1 AS mv, price / base - 1 AS ac, rank <= win AS cur, rank > win AND rank <= 2 * win AS prev, id % 5 <> 0 AS has_view, (id % 7) / 1000.0::DOUBLE AS disagreement FROM settled, (SELECT unnest([30, 90]) AS win)),
g AS (SELECT instrument, version, horizon, CAST(win AS INTEGER) AS "window", count(*) FILTER (WHERE cur) AS predictions, count(*) FILTER (WHERE cur AND price IS NOT NULL) AS resolved, avg(abs(mv - ac)) FILTER (WHERE cur) AS mae, avg(mv - ac) FILTER (WHERE cur) AS bias, avg(abs(p50 - price)) FILTER (WHERE cur) AS price_mae,
  avg((sign(mv) = sign(ac))::INT) FILTER (WHERE cur AND has_view AND ac <> 0 AND mv <> 0) AS direction, count(*) FILTER (WHERE cur AND has_view AND ac <> 0 AND mv <> 0) AS directional, avg((price BETWEEN p10 AND p90)::INT) FILTER (WHERE cur) AS coverage, avg(disagreement) FILTER (WHERE cur) AS disagreement,
  avg(mv) FILTER (WHERE cur) AS mean_prediction, CASE WHEN count(*) FILTER (WHERE prev) = win THEN avg(mv) FILTER (WHERE cur) - avg(mv) FILTER (WHERE prev) END AS drift, avg(abs(ac)) FILTER (WHERE cur) AS zero FROM x GROUP BY instrument, version, horizon, win),
k AS (SELECT *, CASE WHEN zero > 0 THEN 1 - mae / zero END AS skill FROM g)
SELECT instrument, version, horizon, "window", predictions, resolved, {", ".join(f"round({c}, 6) AS {c}" for c in ("mae", "bias", "price_mae", "direction"))}, directional, {", ".join(f"round({c}, 6) AS {c}" for c in ("coverage", "disagreement", "mean_prediction", "drift", "skill"))}, coalesce(resolved >= 30 AND skill < 0, false) AS alert FROM k"""
)
def monitoring_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth forecast has no view, and members disagree by up to 0.6 %."""
    s = _settled(spark, sf_dir).withColumns({"has_view": F.col("id") % 5 != 0, "disagreement": (F.col("id") % 7) / 1000.0})
    return all_rounded(ops.monitoring(s))


@query(
    f"""WITH {FORECASTS}, {BARS}, {_SETTLED}, p AS (SELECT *, greatest(0.1 * (price - p10), -0.9 * (price - p10)) AS a, greatest(0.5 * (price - p50), -0.5 * (price - p50)) AS b, greatest(0.9 * (price - p90), -0.1 * (price - p90)) AS c FROM settled WHERE price IS NOT NULL)
SELECT horizon, count(*) AS n, round(avg((price BETWEEN p10 AND p90)::INT), 6) AS coverage, round(avg((a + b + c) / 3), 4) AS pinball, round(avg(CASE WHEN price <> base THEN ((p50 > base) = (price > base))::INT END), 6) AS direction FROM p GROUP BY horizon"""
)
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _settled(spark, sf_dir).where("price IS NOT NULL")
    price = F.col("price")
    loss = sum((ops.pinball(price, F.col(c), q) for c, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))), F.lit(0.0)) / 3
    hit = F.when(price != F.col("base"), ((F.col("p50") > F.col("base")) == (price > F.col("base"))).cast("double"))
    g = s.groupBy("horizon").agg(F.count("*").alias("n"), F.avg(price.between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"), F.avg(loss).alias("pinball"), F.avg(hit).alias("direction"))
    return rounded(rounded(g, "coverage", "direction", digits=6), "pinball", digits=4)


COVERAGES = (0.5, 0.7, 0.8, 0.9)
_ADAPTIVE = "symbol string, horizon int, coverage double, n long, rolling_covered double, rolling_width double, adaptive_covered double, adaptive_width double, last_alpha double"


def _adaptive(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("day", ignore_index=True)
    error = (rows["pred"] - rows["actual"]).abs().to_numpy()
    day, target = (pd.to_datetime(rows[c]).to_numpy() for c in ("day", "target_day"))
    start = np.datetime64("1996-01-01")
    before, test = target < start, day >= start
    out = []
    for c in COVERAGES:
        rolling, adaptive, alpha = adaptive_widths(error[before], error[test], day[test], target[test], c)
        row = {"symbol": rows["symbol"].iloc[0], "horizon": rows["horizon"].iloc[0], "coverage": c, "n": int(test.sum()), "last_alpha": alpha}
        for name, width in (("rolling", rolling), ("adaptive", adaptive)):
            known = ~np.isnan(width)
            row |= {f"{name}_covered": float(np.mean(error[test][known] <= width[known])) if known.any() else None, f"{name}_width": float(np.mean(2 * width[known])) if known.any() else None}
        out.append(row)
    return pd.DataFrame(out, columns=[c.split()[0] for c in _ADAPTIVE.split(", ")])


@query()
def adaptive_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and width of rolling and adaptive intervals since 1996, calibrated on what had matured before."""
    return all_rounded(pairs(spark, sf_dir).groupBy("symbol", "horizon").applyInPandas(_adaptive, _ADAPTIVE))


def _regime_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Momentum forecasts of all folds' test rows with what regimes are read from, and the thirds of each fold's training rows."""
    from ..operators.features import fold_rows
    from ..operators.windows import gold_features

    b = saved(bars_daily(spark, sf_dir))
    g = gold_features(b).select("symbol", "day", F.col("volatility_20").alias("volatility"), F.col("ma50_distance").alias("trend"), F.col("return_20").alias("dollar_change"), F.col("return_5").alias("yield_change"), (F.col("atr14") * 100).alias("fear"))
    f = saved(fold_rows(asof.forward_return(b)).select("symbol", "horizon", "fold", "day", "part").join(g, ["symbol", "day"]))
    cuts = f.where("part = 'train'").groupBy("symbol", "horizon", "fold").agg(F.percentile("volatility", [1 / 3, 2 / 3]).alias("v")).select("symbol", "horizon", "fold", F.col("v")[0].alias("v1"), F.col("v")[1].alias("v2"))
    test = f.where("part = 'test'").join(pairs(spark, sf_dir).select("symbol", "horizon", "day", "pred", "actual", "price"), ["symbol", "horizon", "day"])
    return test, cuts


@query(
    f"""{_FOLDS}, mom AS (SELECT symbol, day, close AS price, close / lag(close, 28) OVER (PARTITION BY symbol ORDER BY day) - 1 AS m FROM bars),
gold AS ({SQL["gold_features_daily"]}), fr AS (SELECT p.symbol, p.horizon, p.fold, p.day, p.part, p.target_return AS actual, volatility_20 AS vol, ma50_distance AS trend, return_20 AS dollar, return_5 AS yield, atr14 * 100 AS fear FROM p JOIN gold ON gold.symbol = p.symbol AND gold.day = p.day WHERE part IS NOT NULL),
cu AS (SELECT symbol, horizon, fold, quantile_cont(vol, 1.0 / 3) AS v1, quantile_cont(vol, 2.0 / 3) AS v2 FROM fr WHERE part = 'train' GROUP BY 1, 2, 3),
te AS (SELECT fr.*, m * fr.horizon / 28 AS pred, v1, v2 FROM fr JOIN cu USING (symbol, horizon, fold) JOIN mom ON mom.symbol = fr.symbol AND mom.day = fr.day WHERE part = 'test' AND actual IS NOT NULL AND m IS NOT NULL),
rg AS (SELECT *, unnest(list_filter([CASE WHEN vol > v2 THEN 'high_vol' END, CASE WHEN vol < v1 THEN 'low_vol' END, CASE WHEN yield > 0 THEN 'rising_yield' END, CASE WHEN yield < 0 THEN 'falling_yield' END, CASE WHEN dollar > 0 THEN 'strong_dollar' END, CASE WHEN dollar < 0 THEN 'weak_dollar' END,
  CASE WHEN trend > 0.02 THEN 'bull' END, CASE WHEN trend < -0.02 THEN 'bear' END, CASE WHEN fear > 20 THEN 'risk_off' END, CASE WHEN fear <= 20 THEN 'risk_on' END], lambda x: x IS NOT NULL)) AS regime FROM te)
SELECT regime, horizon, count(*) AS n, round(avg(abs(pred - actual)), 5) AS mae, round(avg(pred - actual), 5) AS bias, round(1 - avg(abs(pred - actual)) / nullif(avg(abs(actual)), 0), 5) AS skill_mae FROM rg GROUP BY regime, horizon"""
)
def regime_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics in ten regimes over all folds' test rows; bar features stand for the yield's and the dollar's changes and for fear."""
    rows, cuts = _regime_rows(spark, sf_dir)
    m = ops.metrics(ops.regime_flags(rows, cuts, ["symbol", "horizon", "fold"]), ["regime", "horizon"])
    return all_rounded(m.select("regime", "horizon", "n", "mae", "bias", "skill_mae"), 5)


LEVELS = (50, 70, 80, 90)
_FOLD = "symbol string, horizon int, fold int, n long, weight double, error double, raw_error double, zero_error double, " + ", ".join(f"width_{k} double, covered_{k} double" for k in LEVELS)


def _fit_predict(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mean forecast for ``x`` of the networks of all seeds, fitted and scaled on ``a`` and ``y`` alone."""
    scale = fits.scaler(a)
    z, new = fits.scaled(a, *scale), fits.scaled(x, *scale)
    return np.mean([fits.network_told(fits.fit_network(z, y, seed)[0], new) for seed in fits.SEEDS], axis=0)


def _mlp(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over one fold's test rows: fitted on its training rows, weighted on the first 60 % of its calibration rows, with widths from the others.

    A fold with under 100 training rows, or under 10 for the weight or the widths, tests nothing (n is 0).
    """
    rows = rows.sort_values("day", ignore_index=True)
    train, cal, test = (rows[rows["part"] == p] for p in ("train", "calibrate", "test"))
    cut = max(1, int(len(cal) * 0.6))
    weigh, widen = cal[:cut], cal[cut:]
    if len(widen):
        weigh = weigh[weigh["target_day"] < widen["day"].iloc[0]]
    out = {"symbol": rows["symbol"].iloc[:1], "horizon": rows["horizon"].iloc[:1], "fold": rows["fold"].iloc[:1]}
    names = [c for c in rows.columns if c.startswith("x_")]
    if len(train) < 100 or len(weigh) < 10 or len(widen) < 10 or not len(test):
        return pd.DataFrame(out | {"n": [0]}).reindex(columns=[c.split()[0] for c in _FOLD.split(", ")])
    p = _fit_predict(train[names].to_numpy(), train["actual"].to_numpy(), pd.concat([weigh, widen, test])[names].to_numpy())
    pw, pi, pt = np.split(p, [len(weigh), len(weigh) + len(widen)])
    yw, yi, yt = (d["actual"].to_numpy() for d in (weigh, widen, test))
    centred = pw - pw.mean()
    slope = float(np.clip(centred @ yw / (centred @ centred), 0, 1)) if centred @ centred >= 1e-18 else 0.0
    weight = slope if np.mean((slope * pw - yw) ** 2) < np.mean(yw**2) else 0.0
    usual = max(float(train["x_volatility_20"].median()), 1e-9)
    si, st = (np.clip(d["x_volatility_20"].to_numpy() / usual, 0.75, 2.0) for d in (widen, test))
    missed = np.abs(yt - weight * pt)
    out |= {"n": [len(test)], "weight": [weight * len(test)], "error": [missed.sum()], "raw_error": [np.abs(yt - pt).sum()], "zero_error": [np.abs(yt).sum()]}
    for k in LEVELS:
        width = np.quantile(np.abs(yi - weight * pi) / si, k / 100) * st
        out |= {f"width_{k}": [width.sum()], f"covered_{k}": [float((missed <= width).sum())]}
    return pd.DataFrame(out)


def _design(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.features import GOLD
    from ..operators.windows import gold_features

    b = saved(bars_daily(spark, sf_dir))
    x = gold_features(b).select("symbol", "day", *(F.col(c).alias(f"x_{c}") for c in GOLD))
    l = asof.forward_return(b).where("target_return IS NOT NULL").withColumnRenamed("target_return", "actual")
    return l.join(x, ["symbol", "day"])


@query()
def mlp_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small networks, fitted anew on each purged fold of each symbol and horizon: independent fits that Spark deals out.

    Means over the test rows of all folds that could be fitted; ``folds`` counts these.
    """
    from ..operators.features import fold_rows

    d = _design(spark, sf_dir)
    rows = dealt(fold_rows(d, keep=[c for c in d.columns if c == "actual" or c.startswith("x_")]), "symbol", "horizon", "fold")
    f = rows.groupBy("symbol", "horizon", "fold").applyInPandas(_mlp, _FOLD)
    n = F.nullif(F.sum("n"), F.lit(0))
    means = {"weight": "weight", "mae": "error", "mae_raw": "raw_error", "mae_zero": "zero_error"} | {f"{c}_{k}": f"{c}_{k}" for k in LEVELS for c in ("width", "covered")}
    g = f.groupBy("symbol", "horizon").agg(F.count_if(F.col("n") > 0).alias("folds"), F.sum("n").alias("n"), *((F.sum(c) / n).alias(name) for name, c in means.items()))
    return all_rounded(g)


@query()
def ridge_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge with an intercept on the training rows of every fold, by sums of products that Spark aggregates, and its errors on the fold's test rows."""
    from ..operators.features import GOLD, fold_rows
    from ..operators.models import linear_fits

    d = _design(spark, sf_dir)
    names, by = [f"x_{c}" for c in GOLD], ["symbol", "horizon", "fold"]
    rows = saved(fold_rows(d, keep=["actual", *names]))
    train = rows.where("part = 'train'")
    w = linear_fits(train, names, "actual", by).where("model = 'ridge'")
    w = w.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("w"))
    deviation = lambda c: F.when(F.stddev_pop(c) < 1e-9, 1.0).otherwise(F.stddev_pop(c))
    scale = train.groupBy(*by).agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(deviation(c).alias(f"s_{c}") for c in names))
    told = sum((F.col("w")[c] * (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in names), F.col("w")["intercept"])
    tested = rows.where("part = 'test'").join(w, by).join(scale, by).withColumns({"pred": told, "price": F.lit(1.0)})
    m = ops.metrics(tested, by).select(*by, "n", "mae", "rmse", "bias", "skill_mae")
    return all_rounded(m.join(w.select(*by, F.map_entries("w").alias("e")), by).select(*by, "n", "mae", "rmse", "bias", "skill_mae", F.explode("e").alias("f")).select(*by, "n", "mae", "rmse", "bias", "skill_mae", F.regexp_replace("f.key", "^x_", "").alias("feature"), F.col("f.value").alias("weight")))
