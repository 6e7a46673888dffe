"""Attribution, out-of-distribution measures and ensemble weights of small models.

Sums of products are aggregated in Spark; what is solved from them has as many
rows as there are features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fits
from ..sources.tables import saved


def effects(rows: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, feature, effect): what of a linear score each feature adds over its mean."""
    means = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in weights)).first()
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), (F.lit(w) * (F.col(c) - F.lit(means[f"m_{c}"]))).alias("effect")) for c, w in weights.items())))
    return rows.select(*keys, parts.alias("p")).select(*keys, "p.*")


def outside(rows: DataFrame, columns: Sequence[str], by: list[str], limit: float = 3.0) -> DataFrame:
    """Rows with the number of features more than ``limit`` deviations from their group's mean."""
    w = Window.partitionBy(*by)
    z = lambda c: F.abs((F.col(c) - F.avg(c).over(w)) / F.when(F.stddev_pop(c).over(w) < 1e-9, 1.0).otherwise(F.stddev_pop(c).over(w)))
    return rows.withColumn("n_outside", sum(((z(c) > limit).cast("int") for c in columns), F.lit(0)))


def gram(rows: DataFrame, columns: Sequence[str], by: list[str]) -> DataFrame:
    """n, sums and sums of products of the columns for each group."""
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(columns)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def _matrix(r: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = r["n"]
    mean = np.array([r[f"s_{i}"] for i in range(k)]) / n
    second = np.array([[r[f"p_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n
    return mean, second


def simplex(g: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Weights, positive and of sum 1, that minimise w' g w, by projected gradient."""
    k = len(g)
    w = np.full(k, 1 / k)
    rate = 1 / (2 * np.linalg.eigvalsh(g).max() + 1e-12)
    for _ in range(steps):
        v = w - rate * 2 * g @ w
        u = np.sort(v)[::-1]
        over = u - (np.cumsum(u) - 1) / np.arange(1, k + 1)
        rho = np.flatnonzero(over > 0)[-1]
        w = np.maximum(v - (u[: rho + 1].sum() - 1) / (rho + 1), 0)
    return w


def ensemble_weights(errors: DataFrame, columns: Sequence[str], by: list[str]) -> DataFrame:
    """(by, member, weight): how to weigh members so that the squared error of their mean is least."""

    def solve(batches):
        for rows in batches:
            for r in rows.to_dict("records"):
                w = simplex(_matrix(r, len(columns))[1])
                yield pd.DataFrame({**{c: [r[c]] * len(columns) for c in by}, "member": list(columns), "weight": np.round(w, 4)})

    g = gram(errors, columns, by)
    schema = ", ".join(f"{c} {g.schema[c].dataType.simpleString()}" for c in by) + ", member string, weight double"
    return g.mapInPandas(solve, schema)


def linear_fits(rows: DataFrame, columns: Sequence[str], target: str, by: list[str]) -> DataFrame:
    """(by, n, model, feature, weight) of ridge and elastic net with an intercept, in columns standardised by the group's own rows.

    A group of any size becomes one row of sums; each group solves its own small system.
    """
    k = len(columns)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.to_dict("records"):
                mean, second = _matrix(r, k + 1)
                cov = second - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
                sd = np.where(sd < 1e-9, 1.0, sd)
                s = fits.Sums(r["n"], np.zeros(k), mean[k], cov[:k, :k] / np.outer(sd, sd), cov[:k, k] / sd)
                for model, (w, b) in (("ridge", fits.fit_ridge(s)), ("elasticnet", fits.fit_elastic(s))):
                    yield pd.DataFrame({**{c: [r[c]] * (k + 1) for c in by}, "n": r["n"], "model": model, "feature": [*columns, "intercept"], "weight": [*w, b]})

    g = gram(rows, [*columns, target], by)
    schema = ", ".join(f"{c} {g.schema[c].dataType.simpleString()}" for c in by) + ", n long, model string, feature string, weight double"
    return g.mapInPandas(solve, schema)


def logistic_fits(rows: DataFrame, columns: Sequence[str], up: str, by: list[str], steps: int = 25, tolerance: float = 1e-8, c: float = 0.1) -> DataFrame:
    """(by, feature, weight) of logistic fits of ``up`` (0 or 1) on standardised columns, by Newton's steps.

    A step is one aggregate over all rows of all groups: the gradient and the second
    derivatives at the weights so far. Weights are penalised by their squares over
    2 ``c``, the intercept is not. Groups of one outcome keep finite weights but for
    the intercept, which grows with the steps.
    """
    k, names = len(columns), [*columns, "intercept"]
    w = Window.partitionBy(*by)
    sd = lambda x: F.when(F.stddev_pop(x).over(w) < 1e-9, 1.0).otherwise(F.stddev_pop(x).over(w))
    z = saved(rows.select(*by, F.col(up).alias("up"), *(((F.col(x) - F.avg(x).over(w)) / sd(x)).alias(f"z{i}") for i, x in enumerate(columns)), F.lit(1.0).alias(f"z{k}")))
    weights = z.select(*by).distinct().withColumn("w", F.array(*[F.lit(0.0)] * (k + 1)))
    kinds = ", ".join(f"{x} {z.schema[x].dataType.simpleString()}" for x in by)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.to_dict("records"):
                g = np.array([r[f"g{i}"] for i in range(k + 1)])
                h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
                old = np.array(r["w"])
                new = fits.newton_step(old, g, h, c)
                yield pd.DataFrame([{**{x: r[x] for x in by}, "w": new, "moved": float(np.abs(new - old).max())}])

    for _ in range(steps):
        j = z.join(weights, by)
        score = sum((F.col("w")[i] * F.col(f"z{i}") for i in range(k + 1)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.least(F.greatest(score, F.lit(-40.0)), F.lit(40.0))))
        j = j.withColumn("p", p)
        curve = F.col("p") * (1 - F.col("p"))
        sums = [F.sum((F.col("p") - F.col("up")) * F.col(f"z{i}")).alias(f"g{i}") for i in range(k + 1)]
        sums += [F.sum(curve * F.col(f"z{a}") * F.col(f"z{b}")).alias(f"h{a}_{b}") for a in range(k + 1) for b in range(a, k + 1)]
        made = saved(j.groupBy(*by).agg(F.first("w").alias("w"), *sums).mapInPandas(step, f"{kinds}, w array<double>, moved double"))
        weights, moved = made.drop("moved"), made.agg(F.max("moved")).first()[0]
        if moved is None or moved <= tolerance:
            break
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("w").alias("weight")))
    return weights.select(*by, pairs.alias("f")).select(*by, "f.feature", "f.weight")


def _shrunk(cov: np.ndarray, fourth: float, n: int) -> np.ndarray:
    """The covariance, shrunk to its mean variance as far as its own noise says (Ledoit and Wolf, 2004); ``fourth`` is the mean of the squared squared lengths."""
    p = len(cov)
    mu, norm = np.trace(cov) / p, (cov**2).sum()
    distance = (norm - 2 * mu * np.trace(cov) + p * mu * mu) / p
    noise = min((fourth - norm) / (p * n), distance)
    share = noise / distance if noise > 0 and distance > 0 else 0.0
    return (1 - share) * cov + share * mu * np.eye(p)


def shrunk_inverse(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and inverse of the shrunk covariance, of one group's rows."""
    c = z - z.mean(axis=0)
    return z.mean(axis=0), np.linalg.pinv(_shrunk(c.T @ c / len(c), float(((c * c).sum(axis=1) ** 2).mean()), len(c)))


def mahalanobis(train: DataFrame, rows: DataFrame, columns: Sequence[str], by: list[str], keys: list[str]) -> DataFrame:
    """(keys, distance, threshold, outside) of each row from its group's training rows, in standardised columns.

    The threshold is the 99 % point of the training rows' own distances. All that
    the covariance needs are aggregated sums; its inverse travels to the rows as an
    array column, one for each group.
    """
    k = len(columns)
    stats = train.groupBy(*by).agg(F.array(*map(F.avg, columns)).alias("centre"), F.array(*(F.when(F.stddev_pop(c) < 1e-9, 1.0).otherwise(F.stddev_pop(c)) for c in columns)).alias("spread"))

    def standardised(df: DataFrame) -> DataFrame:
        z = F.zip_with(F.zip_with(F.array(*columns), F.col("centre"), lambda a, b: a - b), F.col("spread"), lambda a, b: a / b)
        return df.join(stats, by).withColumn("z", z).drop("centre", "spread")

    def invert(batches):
        for part in batches:
            for r in part.to_dict("records"):
                mean, second = _matrix(r, k)
                cov = _shrunk(second - np.outer(mean, mean), r["fourth"], r["n"])
                yield pd.DataFrame([{**{c: r[c] for c in by}, "inverse": np.linalg.inv(cov).ravel()}])

    names = [f"z_{i}" for i in range(k)]
    learned = standardised(train)
    flat = learned.select(*by, *(F.col("z")[i].alias(c) for i, c in enumerate(names)), F.pow(F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v), 2.0).alias("fourth"))
    g = gram(flat, names, by).join(flat.groupBy(*by).agg(F.avg("fourth").alias("fourth")), by)
    schema = ", ".join(f"{c} {g.schema[c].dataType.simpleString()}" for c in by) + ", inverse array<double>"
    inverses = g.mapInPandas(invert, schema)
    square = F.aggregate(F.sequence(F.lit(0), F.lit(k * k - 1)), F.lit(0.0), lambda s, i: s + F.get(F.col("inverse"), i) * F.get(F.col("z"), F.floor(i / k).cast("int")) * F.get(F.col("z"), i % k))
    limits = learned.join(inverses, by).groupBy(*by).agg(F.percentile(F.sqrt(square), 0.99).alias("threshold"))
    d = standardised(rows).join(inverses, by).join(limits, by)
    return d.select(*keys, F.sqrt(square).alias("distance"), "threshold").withColumn("outside", F.col("distance") > F.col("threshold"))


def serve(rows: DataFrame, columns: Sequence[str], mean: Sequence[float], spread: Sequence[float], members: Sequence[tuple[Sequence[float], float]], weight: float, error: float, usual_volatility: float, neutral: Sequence[str] = ()) -> DataFrame:
    """What an ensemble of linear members serves for each row (symbol, close, ``columns``): (symbol, mean, disagreement, error, price, clipped, status).

    Inputs are standardised and clipped at 6; those beyond are named, and the row
    is out of distribution. Inputs in ``neutral`` count as their mean. The mean of
    the members is weighted, their deviation is the disagreement, and the error
    follows the volatility within 0.75 and 2 times its usual value.
    """
    raw = [(F.col(c) - m) / s for c, m, s in zip(columns, mean, spread, strict=True)]
    z = [F.lit(0.0) if c in neutral else F.least(F.lit(6.0), F.greatest(F.lit(-6.0), x)) for c, x in zip(columns, raw, strict=True)]
    told = F.array(*(sum((F.lit(w) * x for w, x in zip(ws, z, strict=True)), F.lit(b)) for ws, b in members))
    rows = rows.withColumn("told", told)
    average = F.aggregate("told", F.lit(0.0), lambda s, v: s + v) / len(members)
    variance = F.aggregate("told", F.lit(0.0), lambda s, v: s + (v - average) * (v - average)) / len(members)
    scale = F.least(F.greatest(F.col("volatility_20") / max(usual_volatility, 1e-9), F.lit(0.75)), F.lit(2.0))
    clipped = F.array_join(F.array_compact(F.array(*(F.when(F.abs(x) > 6, F.lit(c)) for c, x in zip(columns, raw, strict=True)))), ",")
    kept = [c for c in ("symbol", "day") if c in rows.columns]
    out = rows.select(*kept, (weight * average).alias("mean"), (weight * F.sqrt(variance)).alias("disagreement"), (error * scale).alias("error"), (F.col("close") * (1 + weight * average)).alias("price"), clipped.alias("clipped"))
    return out.withColumn("status", F.when(F.col("clipped") != "", "OUT_OF_DISTRIBUTION").otherwise("OK"))


def mutual_information(rows: DataFrame, x: str, y: str, by: list[str], bins: int = 8) -> DataFrame:
    """Mutual information in nats of two columns cut into equally filled bins."""
    cut = lambda c: F.ntile(bins).over(Window.partitionBy(*by).orderBy(c, *[k for k in rows.columns if k == "day"]))
    b = rows.select(*by, cut(x).alias("i"), cut(y).alias("j"))
    joint = b.groupBy(*by, "i", "j").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    p = joint.select(*by, "n", F.sum("n").over(Window.partitionBy(*by, "i")).alias("ni"), F.sum("n").over(Window.partitionBy(*by, "j")).alias("nj"), F.sum("n").over(w).alias("t"))
    return p.groupBy(*by).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ni") * F.col("nj")))).alias("information"))


def permutation_importance(rows: pd.DataFrame, columns: Sequence[str], weights: np.ndarray, block: int = 20, repeats: int = 3, seed: int = 27) -> pd.DataFrame:
    """Rise of a linear model's absolute error when a feature's blocks of rows are shuffled."""
    g = np.random.default_rng(seed)
    x, y = rows[list(columns)].to_numpy(), rows["actual"].to_numpy()
    base = np.abs(x @ weights - y).mean()
    starts = np.arange(0, len(x), block)
    out = []
    for i in range(len(columns)):
        rise = []
        for _ in range(repeats):
            order = np.concatenate([np.arange(s, min(s + block, len(x))) for s in g.permutation(starts)])
            z = x.copy()
            z[:, i] = x[order, i]
            rise.append(np.abs(z @ weights - y).mean() - base)
        out.append(float(np.mean(rise)))
    return pd.DataFrame({"feature": list(columns), "importance": np.round(out, 6)})
