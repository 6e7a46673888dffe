"""Queries over the grid of experiments: every specification, horizon and purged fold of every symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof
from ..operators import evaluate as metrics
from ..operators import experiments as ops
from ..operators.features import GOLD, feature_table, fold_rows
from ..operators.models import linear_fits, logistic_fits
from ..operators.windows import engineered, gold_features
from ..sources.tables import BARS, bars_daily, macro_observations, saved, shared_dir
from .features import _GOLD_CTE
from .joins import LABELS
from .features import _GOLD_CTE
from .joins import LABELS
from .registry import query
from .windows import all_rounded

#: Raised when a fit of the same rows would give another result, so that stored ones are not taken for it.
REVISION = 1
_BY = ["symbol", "horizon", "spec"]


def design_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ops.Design]:
    """Labelled rows with bar features, all macro series as of each day, and engineered ones; and the design that names them."""
    b = saved(bars_daily(spark, sf_dir))
    macro = macro_observations(spark, sf_dir).where("vintage = 'initial'").select("series", F.col("obs_date").alias("day"), "value")
    table = feature_table(b, macro)
    table = table.select(*(c for c in table.columns if not c.startswith("target_")))
    levels = [c for c in table.columns if c.endswith("_level")]
    macro_columns = {c[2 : -len("_level")]: (c, c[: -len("level")] + "change") for c in levels}
    extra = engineered(b)
    labels = asof.forward_return(b).where("target_return IS NOT NULL").withColumnRenamed("target_return", "actual")
    rows = labels.join(table, ["symbol", "day"]).join(extra, ["symbol", "day"], "left").join(b.select("symbol", "day", F.col("close").alias("price")), ["symbol", "day"])
    momentum, volatility = ("return_1", "return_5", "return_20", "ma50_distance", "rsi14"), ("atr14", "volatility_20")
    themes = {"momentum": momentum, "volatility": volatility}
    lag = {theme: (45, 10, 2)[k % 3] for k, theme in enumerate(macro_columns)}
    design = ops.Design(GOLD, macro_columns, [c for c in extra.columns if c not in ("symbol", "day")], themes, "volatility_20", "ma50_distance", "return_20", lag)
    return rows, design


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid over all symbols, kept in the shared folder under a fingerprint of its rows: what has been fitted once is read."""
    rows, design = design_rows(spark, sf_dir)
    keep = [c for c in rows.columns if c not in ("symbol", "horizon", "day", "target_day")]
    folds = saved(fold_rows(rows, calibration=0.0, least=126, keep=keep))
    registry = ops.specs(design)
    sums = folds.agg(F.count("*"), F.sum(F.xxhash64(*folds.columns).cast("decimal(38,0)"))).first()
    mark = F.sha2(F.lit(f"{REVISION} {registry} {design} {sums[0]} {sums[1]}"), 256)
    path = f"{shared_dir(spark)}/experiments-{spark.range(1).select(mark).first()[0]}"
    return ops.run_grid(folds, registry, design, path)


@query()
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each specification, horizon, fold and symbol: its state, its rows and weight, and its errors on the test rows."""
    g = grid(spark, sf_dir)
    m = metrics.metrics(ops.tested(g), ops.KEYS).select(*ops.KEYS, "n", "mae", "rmse", "median_ae", "bias", "direction", "active_fraction", "skill_mae", "skill_mse")
    return all_rounded(g.select(*ops.KEYS, "state", "training_rows", "weight_rows", "interval_rows", "weight", "converged").join(m, ops.KEYS, "left"))


@query()
def experiment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over all folds of a specification, the folds it beats the zero forecast in, and how its error differs between folds."""
    rows = ops.tested(grid(spark, sf_dir))
    folds = metrics.metrics(rows, ops.KEYS).groupBy(*_BY).agg(F.count("*").alias("folds"), F.count_if(F.col("skill_mae") > 0).alias("positive_folds"), F.stddev_pop("mae").alias("fold_mae_sd"))
    return all_rounded(metrics.metrics(rows, _BY).join(folds, _BY))


@query()
def experiment_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empirical coverage, width and score of split, volatility-normalised, rolling and adaptive intervals."""
    return all_rounded(ops.interval_report(ops.tested(grid(spark, sf_dir)), _BY))


@query()
def experiment_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left, and how well it does, where a forecast is kept under one of three rules only."""
    rows = ops.tested(grid(spark, sf_dir)).where(F.col("spec").isin("mlp_nested", "mlp_serving_replay", "ridge", "heterogeneous_calibrated"))
    whole = rows.groupBy(*_BY).agg(F.count("*").alias("of"))
    m = metrics.metrics(ops.abstentions(rows), [*_BY, "rule"]).join(whole, _BY)
    return all_rounded(m.select(*_BY, "rule", "n", (F.col("n") / F.col("of")).alias("coverage"), "mae", "direction", "skill_mae"))


@query()
def experiment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each specification against the majority baseline on the same rows, with block intervals."""
    return all_rounded(ops.paired(ops.tested(grid(spark, sf_dir)), "direction_majority"))


@query()
def experiment_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rise of the test error when blocks of a feature's rows change places, over all folds; and the members' weights of the ensemble."""
    g = grid(spark, sf_dir).where("state = 'ok'")
    of = lambda c: g.select(*_BY, F.explode(c).alias("name", "value")).groupBy(*_BY, F.lit(c).alias("part"), "name").agg(F.avg("value").alias("value"))
    return all_rounded(of("importance").unionByName(of("members")))


@query()
def legacy_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier protocol, reported as it was: its weight is read off the rows it is tested on, so its figures flatter it."""
    rows, design = design_rows(spark, sf_dir)
    names = design.full
    schema = "symbol string, horizon int, day date, price double, actual double, raw double, weight double"
    told = rows.select("symbol", "horizon", "day", "price", "actual", *names).groupBy("symbol", "horizon").applyInPandas(lambda g: ops.legacy_recipe(g, names), schema)
    both = F.explode(F.array(F.struct(F.lit("raw").alias("served"), F.col("raw").alias("pred")), F.struct(F.lit("weighted").alias("served"), (F.col("weight") * F.col("raw")).alias("pred"))))
    rows = told.withColumn("s", both).select("symbol", "horizon", "price", "actual", "weight", "s.*")
    m = metrics.metrics(rows, ["symbol", "horizon", "served", "weight"])
    return all_rounded(m.select("symbol", "horizon", "served", "weight", "n", "mae", "rmse", "bias", "direction", "skill_mae", "skill_mse"))


@query()
def linear_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge and elastic net on the training rows of every fold, from sums of products that Spark aggregates; weights are those of standardised columns."""
    rows, design = design_rows(spark, sf_dir)
    folds = fold_rows(rows, calibration=0.0, least=126, keep=["actual", *design.full])
    return all_rounded(linear_fits(folds.where("part = 'train'"), design.full, "actual", ["symbol", "horizon", "fold"]))


@query()
def logistic_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction of the target by Newton's steps, each one aggregate over the training rows of all folds."""
    rows, design = design_rows(spark, sf_dir)
    folds = fold_rows(rows, calibration=0.0, least=126, keep=["actual", *design.technical])
    train = folds.where("part = 'train'").withColumn("up", (F.col("actual") > 0).cast("double"))
    return all_rounded(logistic_fits(train, design.technical, "up", ["symbol", "horizon", "fold"]))


_STEP = ("return_20", "rsi14")


@query(
    f"""WITH {BARS}, {_GOLD_CTE}, {LABELS}, lg AS (SELECT l.symbol, l.horizon, (target_return > 0)::INT::DOUBLE AS up, return_20 AS a, rsi14 AS b FROM f JOIN labels_ l USING (symbol, day) WHERE f.n > 60 AND target_return IS NOT NULL),
lz AS (SELECT symbol, horizon, up, (a - avg(a) OVER w) / stddev_pop(a) OVER w AS a, (b - avg(b) OVER w) / stddev_pop(b) OVER w AS b FROM lg WINDOW w AS (PARTITION BY symbol, horizon)),
ls AS (SELECT symbol, horizon, sum((0.5 - up) * a) AS ga, sum((0.5 - up) * b) AS gb, sum(0.5 - up) AS gc, 0.25 * sum(a * a) + 10 AS aa, 0.25 * sum(a * b) AS ab, 0.25 * sum(a) AS ac, 0.25 * sum(b * b) + 10 AS bb, 0.25 * sum(b) AS bc, 0.25 * count(*) AS cc FROM lz GROUP BY 1, 2),
ld AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM ls)
SELECT symbol, horizon, unnest(['return_20', 'rsi14', 'intercept']) AS feature, unnest([round(-(ga * (bb * cc - bc * bc) - ab * (gb * cc - bc * gc) + ac * (gb * bc - bb * gc)) / det, 6),
  round(-(aa * (gb * cc - bc * gc) - ga * (ab * cc - bc * ac) + ac * (ab * gc - gb * ac)) / det, 6), round(-(aa * (bb * gc - gb * bc) - ab * (ab * gc - gb * ac) + ga * (ab * bc - bb * ac)) / det, 6)]) AS weight FROM ld"""
)
def logistic_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of Newton's steps from zero, on two standardised columns."""
    b = saved(bars_daily(spark, sf_dir))
    rows = asof.forward_return(b).where("target_return IS NOT NULL").join(gold_features(b), ["symbol", "day"])
    rows = rows.withColumn("up", (F.col("target_return") > 0).cast("double"))
    return all_rounded(logistic_fits(rows, _STEP, "up", ["symbol", "horizon"], steps=1))
