"""Metrics of forecasts, calibration, regimes, and the forecast ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Errors, direction and skill of ``pred`` against ``actual`` for each of ``by``; ``price`` turns returns into money.

    A prediction of 0 abstains: it is not active. ``direction`` is over active
    predictions of moves, ``direction_all`` over all rows, ``active_direction`` over
    active ones; the balanced one is the mean of both directions' hits. Skills
    compare with the zero forecast, by absolute and by squared error.
    """
    y, p = F.col("actual"), F.col("pred")
    e = p - y
    active, same = F.abs(p) > 1e-12, (F.signum(p) == F.signum(y)).cast("double")
    share = lambda where, what: F.avg(F.when(where, what.cast("double")))
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.percentile(F.abs(e), 0.5).alias("median_ae"),
        F.avg(e).alias("bias"),
        share(active & (y != 0), same).alias("direction"),
        F.avg(same).alias("direction_all"),
        ((share(active & (y > 0), p > 0) + share(active & (y < 0), p < 0)) / 2).alias("balanced_direction"),
        share(active, same).alias("active_direction"),
        F.avg(active.cast("double")).alias("active_fraction"),
        F.when((F.stddev_pop("actual") > 0) & (F.stddev_pop("pred") > 1e-12), F.covar_pop("pred", "actual") / F.nullif(F.stddev_pop("actual") * F.stddev_pop("pred"), F.lit(0.0))).alias("correlation"),
        (1 - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
        F.when(F.regr_sxx("actual", "pred") > 1e-18, F.regr_slope("actual", "pred")).alias("slope"),
        (1 - F.avg(F.abs(e)) / F.nullif(F.avg(F.abs(y)), F.lit(0.0))).alias("skill_mae"),
        (1 - F.avg(e * e) / F.nullif(F.avg(y * y), F.lit(0.0))).alias("skill_mse"),
        F.avg(F.abs(e) * F.col("price")).alias("price_mae"),
        F.avg((F.abs(e) * F.col("price") <= 2).cast("double")).alias("within_2"),
        F.avg((y > 0).cast("double")).alias("always_up"),
    )


def served_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """What was served (pred, weight) against ``actual``: active with a weight of 0.2 and more; an abstention has no direction."""
    y, p = F.col("actual"), F.col("pred")
    active = F.col("weight") >= 0.2
    directional = active & (F.abs(y) > 1e-12) & (F.abs(p) > 1e-12)
    e = y - p
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(-e).alias("bias"),
        F.avg(F.when(directional, ((y > 0) == (p > 0)).cast("double"))).alias("direction"),
        F.count_if(directional).alias("directional_rows"),
        F.avg(active.cast("double")).alias("active_fraction"),
        F.avg(F.abs(y)).alias("mae_zero"),
        F.sqrt(F.avg(y * y)).alias("rmse_zero"),
        (1 - F.avg(F.abs(e)) / F.nullif(F.avg(F.abs(y)), F.lit(0.0))).alias("skill_mae"),
        (1 - F.avg(e * e) / F.nullif(F.avg(y * y), F.lit(0.0))).alias("skill_mse"),
        F.avg((F.abs(e) <= 0.02).cast("double")).alias("within_2pp"),
    )


def shrinkage(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Slope of actual on pred clipped to 0..1; 0 without spread or without gain over the zero forecast."""
    s = pairs.groupBy(*by).agg(F.regr_slope("actual", "pred").alias("slope"), F.regr_sxx("actual", "pred").alias("sxx"))
    w = s.select(*by, F.when(F.col("sxx") < 1e-18, 0.0).otherwise(F.least(F.greatest("slope", F.lit(0.0)), F.lit(1.0))).alias("w"))
    gain = pairs.join(w, by).groupBy(*by).agg(F.first("w").alias("w"), F.avg(F.pow(F.col("w") * F.col("pred") - F.col("actual"), 2.0)).alias("with_"), F.avg(F.col("actual") * F.col("actual")).alias("without"))
    return gain.select(*by, F.when(F.col("with_") < F.col("without"), F.col("w")).otherwise(0.0).alias("weight"))


def conformal(scores: DataFrame, by: list[str], coverage: float) -> DataFrame:
    """The order statistic at rank min(n, ceil((n + 1) coverage)), found by ranks."""
    w = Window.partitionBy(*by)
    r = scores.select(*by, "score", F.row_number().over(w.orderBy("score")).alias("r"), F.count("*").over(w).alias("n"))
    return r.where(F.col("r") == F.least("n", F.ceil((F.col("n") + 1) * coverage))).select(*by, "n", F.col("score").alias("width"))


def coverage(errors: DataFrame, widths: DataFrame, by: list[str], level: float) -> DataFrame:
    """Share of errors within the width, mean width, and interval score."""
    j = errors.join(widths, by)
    over = F.greatest(F.abs("error") - F.col("width"), F.lit(0.0))
    return j.groupBy(*by).agg(F.avg((F.abs("error") <= F.col("width")).cast("double")).alias("covered"), F.avg(2 * F.col("width")).alias("mean_width"), F.avg(2 * F.col("width") + 2 / (1 - level) * over).alias("interval_score"))


def pinball(actual: Column, forecast: Column, q: float) -> Column:
    d = actual - forecast
    return F.greatest(q * d, (q - 1) * d)


def distribution(rows: DataFrame, by: list[str], x: str, tail: float) -> DataFrame:
    """Moments (population; excess kurtosis), range, quantiles and the share beyond ``tail``."""
    return rows.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"), *(F.percentile(x, q).alias(f"q{round(100 * q):02}") for q in (0.05, 0.25, 0.75, 0.95)), F.min(x).alias("min"), F.max(x).alias("max"), F.avg((F.abs(x) > tail).cast("double")).alias("tail")
    )


def regimes(rows: DataFrame, feature: str, cuts: DataFrame) -> DataFrame:
    """Rows labelled low, middle or high by two thresholds of a one-row table."""
    r = F.when(F.col(feature) <= F.col("c1"), "low").when(F.col(feature) <= F.col("c2"), "middle").otherwise("high")
    return rows.join(F.broadcast(cuts.limit(1))).withColumn("regime", r).drop("c1", "c2")


def regime_flags(rows: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Rows once for each regime that they lie in, of ten: volatility beyond the training rows' thirds (``cuts``), and the signs of trend, yield, dollar and fear.

    ``rows`` has volatility, trend, yield_change, dollar_change and fear.
    """
    c, v = F.col, F.col("volatility")
    flags = {
        "high_vol": v > c("v2"), "low_vol": v < c("v1"), "rising_yield": c("yield_change") > 0, "falling_yield": c("yield_change") < 0, "strong_dollar": c("dollar_change") > 0,
        "weak_dollar": c("dollar_change") < 0, "bull": c("trend") > 0.02, "bear": c("trend") < -0.02, "risk_off": c("fear") > 20, "risk_on": c("fear") <= 20,
    }
    names = F.array_compact(F.array(*(F.when(x, F.lit(k)) for k, x in flags.items())))
    return rows.join(cuts, by).withColumn("regime", F.explode(names)).drop("v1", "v2")


def first_issuance(forecasts: DataFrame, keep: int = 180) -> DataFrame:
    """The first forecast of each (instrument, version, horizon, origin), and its recency rank, the latest ``keep``."""
    first = F.row_number().over(Window.partitionBy("instrument", "version", "horizon", "origin").orderBy("issued_at", "id"))
    f = forecasts.withColumn("k", first).where("k = 1").drop("k")
    rank = F.row_number().over(Window.partitionBy("instrument", "version", "horizon").orderBy(F.desc("origin")))
    return f.withColumn("rank", rank).where(F.col("rank") <= keep)


def monitoring(ranked: DataFrame, sizes: tuple[int, ...] = (30, 90)) -> DataFrame:
    """Metrics of the latest forecasts of each instrument, version and horizon by window.

    Direction counts forecasts that have a view and outcomes that moved. The drift
    of the mean prediction needs a full window before. A window of at least 30
    outcomes that do worse than the zero forecast is an alert.
    """
    r = ranked.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("window"))
    now, before = F.col("rank") <= F.col("window"), (F.col("rank") > F.col("window")) & (F.col("rank") <= 2 * F.col("window"))
    known = now & F.col("price").isNotNull()
    move, actual = F.col("p50") / F.col("base") - 1, F.col("price") / F.col("base") - 1
    of = lambda x, where=known: F.avg(F.when(where, x))
    viewed = known & F.col("has_view") & (actual != 0) & (move != 0)
    g = r.groupBy("instrument", "version", "horizon", "window").agg(
        F.count_if(now).alias("predictions"),
        F.count_if(known).alias("resolved"),
        of(F.abs(move - actual)).alias("mae"),
        of(move - actual).alias("bias"),
        of(F.abs(F.col("p50") - F.col("price"))).alias("price_mae"),
        of((F.signum(move) == F.signum(actual)).cast("double"), viewed).alias("direction"),
        F.count_if(viewed).alias("directional"),
        of(F.col("price").between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"),
        of(F.col("disagreement"), now).alias("disagreement"),
        of(move, now).alias("mean_prediction"),
        F.when(F.count_if(before) == F.col("window"), of(move, now) - of(move, before)).alias("drift"),
        of(F.abs(actual)).alias("zero"),
    )
    skill = F.when(F.col("zero") > 0, 1 - F.col("mae") / F.col("zero"))
    return g.withColumn("skill", skill).withColumn("alert", F.coalesce((F.col("resolved") >= 30) & (F.col("skill") < 0), F.lit(False))).drop("zero")


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation, ties with their average rank."""

    def ranked(df: DataFrame, c: str) -> DataFrame:
        w = Window.partitionBy(*by)
        return df.withColumn(f"rank_{c}", F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2)

    r = ranked(ranked(rows, x), y)
    return r.groupBy(*by).agg(F.corr(x, y).alias("pearson"), F.corr(f"rank_{x}", f"rank_{y}").alias("spearman"))


def correlations(rows: DataFrame, columns: list[str], by: list[str], keys: list[str]) -> DataFrame:
    """(by, a, b, n, pearson, spearman) of all pairs of columns; tied values have their average rank, rows that lack any column are left out.

    ``keys`` identify a row of a group. Each column of each group is ranked by
    itself; then one aggregate of products, over values and ranks, gives all pairs.
    """
    known = rows.dropna(subset=columns).select(*by, *keys, *(F.col(c).cast("double").alias(c) for c in columns))
    each = F.posexplode(F.array(*columns)).alias("c", "v")
    long = known.select(*by, *keys, each)
    w = Window.partitionBy(*by, "c")
    ranked = long.withColumn("r", F.rank().over(w.orderBy("v")) + (F.count("*").over(Window.partitionBy(*by, "c", "v")) - 1) / 2)
    wide = ranked.groupBy(*by, *keys).agg(F.array_sort(F.collect_list(F.struct("c", "v", "r"))).alias("x"))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    flat = [F.col("x")[i][f].alias(f"{f}{i}") for i in range(len(columns)) for f in "vr"]
    g = wide.select(*by, *flat)
    sums = [F.count("*").alias("n")]
    for f in "vr":
        sums += [F.stddev_pop(f"{f}{i}").alias(f"s{f}{i}") for i in range(len(columns))]
        sums += [F.covar_pop(f"{f}{i}", f"{f}{j}").alias(f"p{f}{i}_{j}") for i, j in pairs]
    one = lambda f, i, j: F.when((F.col(f"s{f}{i}") > 0) & (F.col(f"s{f}{j}") > 0), F.col(f"p{f}{i}_{j}") / F.nullif(F.col(f"s{f}{i}") * F.col(f"s{f}{j}"), F.lit(0.0)))
    out = F.explode(F.array(*(F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), one("v", i, j).alias("pearson"), one("r", i, j).alias("spearman")) for i, j in pairs)))
    return g.groupBy(*by).agg(*sums).select(*by, "n", out.alias("o")).select(*by, "o.a", "o.b", "n", "o.pearson", "o.spearman")


def block_bootstrap(rows: DataFrame, by: tuple[str, ...], block: int = 30, reps: int = 500, seed: int = 104) -> DataFrame:
    """The 2.5 and 97.5 % points of error, direction and skill of (day, pred, actual) under a moving-block bootstrap.

    A replicate is a row of block starts, the last block cut so that it has as many
    rows as there are. A group's running sums are four arrays with one number for
    each day, and the sum over a block is a difference of two of them, so replicates
    join nothing and copy nothing. Starts are hashes, the same everywhere.
    """
    valid = (F.abs("pred") > 1e-12) & (F.col("actual") != 0)
    hit = (valid & (F.signum("pred") == F.signum("actual"))).cast("double")
    parts = {"e": F.abs(F.col("pred") - F.col("actual")), "y": F.abs("actual"), "h": hit, "v": valid.cast("double")}
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.select(*by, F.count("*").over(w).cast("int").alias("i"), *(F.sum(x).over(w).alias(k) for k, x in parts.items()))
    listed = F.array_sort(F.collect_list(F.struct("i", *parts))).alias("r")
    g = r.groupBy(*by).agg(F.max("i").alias("n"), listed)
    g = g.select(*by, "n", F.least(F.lit(block), F.col("n")).alias("b"), *(F.concat(F.array(F.lit(0.0)), F.col(f"r.{k}")).alias(k) for k in parts))
    start = f"cast(conv(substring(md5(concat_ws('-', {seed}, rep, k)), 1, 8), 16, 10) as bigint) % (n - b + 1)"
    one = "transform(sequence(1, cast(ceil(n / b) as int)), k -> named_struct('a', cast(START as int), 'l', cast(least(b, n - (k - 1) * b) as int)))".replace("START", start)
    total = ", ".join(f"'{k}', s.{k} + get({k}, d.a + d.l) - get({k}, d.a)" for k in parts)
    zero = ", ".join(f"'{k}', 0D" for k in parts)
    sums = F.expr(f"transform(sequence(1, {reps}), rep -> aggregate({one}, named_struct({zero}), (s, d) -> named_struct({total})))")
    s = g.select(*by, "n", F.explode(sums).alias("s")).select(*by, "n", "s.*")
    each = s.select(*by, "n", (F.col("e") / F.col("n")).alias("mae"), F.when(F.col("v") > 0.5, F.col("h") / F.col("v")).alias("direction"), F.when(F.col("y") > 0, 1 - F.col("e") / F.col("y")).alias("skill"))
    return each.groupBy(*by, "n").agg(*(F.percentile(c, q).alias(f"{c}_{name}") for c in ("mae", "direction", "skill") for name, q in (("low", 0.025), ("high", 0.975))))
