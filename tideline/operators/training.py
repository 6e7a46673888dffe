"""Training of forecasters, their artifacts, and forecasts read back from them.

An artifact is a table with a row for each symbol and horizon: the columns it
reads, their scaling, the networks' weights, how far its forecasts count, and the
widths of its intervals. It is published as a version, judged beside the champion,
and served from what was stored; training never promotes.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fits
from ..sources.publication import Releases
from ..sources.tables import dealt, saved
from .evaluate import served_metrics
from .experiments import slope
from .features import fold_rows

QUANTILES = (0.5, 0.7, 0.8, 0.9)
#: A forecast whose weight is below this is no view.
CONFIDENT = 0.2
_KEYS = ["symbol", "horizon"]
_FIT = "symbol string, horizon int, fold int, training_rows int, training_end date, target_end date, mean array<double>, sd array<double>, networks array<array<double>>, usual_volatility double, latest double, weight double, actual array<double>, raw array<double>, scale array<double>"
FINAL = -1


def _volatility_scale(v: np.ndarray, usual: float) -> np.ndarray:
    return np.clip(v / max(usual, 1e-9), 0.75, 2.0)


def _fit(rows: pd.DataFrame, columns: Sequence[str], volatility: str) -> pd.DataFrame:
    """One fold's networks and their forecasts of its test rows; the final fold learns all labelled rows and forecasts the last one."""
    rows = rows.sort_values("day", ignore_index=True)
    of = lambda part: rows[rows["part"] == part]
    train, test, cal = of("train"), of("test"), of("calibrate")
    x, y = train[list(columns)].to_numpy(float), train["actual"].to_numpy()
    mean, sd = fits.scaler(x)
    networks = [fits.fit_network(fits.scaled(x, mean, sd), y, seed)[0] for seed in fits.SEEDS]

    def told(some: pd.DataFrame) -> np.ndarray:
        z = fits.scaled(some[list(columns)].to_numpy(float), mean, sd)
        return np.mean([fits.network_told(w, z) for w in networks], axis=0) if len(z) else np.zeros(0)

    usual = float(train[volatility].median())
    early = cal[: max(1, int(len(cal) * 0.6))]
    late = cal[len(early) :]
    early = early[early["target_day"] < late["day"].iloc[0]] if len(late) else early[:0]
    weight = slope(early["actual"].to_numpy(), told(early)) if len(early) >= 10 and len(late) >= 10 else 0.0
    one = rows.iloc[0]
    out = {"symbol": one["symbol"], "horizon": one["horizon"], "fold": one["fold"], "training_rows": len(train), "training_end": train["day"].max(), "target_end": train["target_day"].max()}
    out |= {"mean": mean, "sd": sd, "networks": [list(w) for w in networks], "usual_volatility": usual, "latest": float(told(of("latest"))[-1]) if len(of("latest")) else None, "weight": weight}
    return pd.DataFrame([out | {"actual": test["actual"].to_numpy(), "raw": told(test), "scale": _volatility_scale(test[volatility].to_numpy(), usual)}])


def train(rows: DataFrame, columns: Sequence[str], volatility: str, least_rows: int = 300, least_tested: int = 100) -> DataFrame:
    """The artifact of labelled rows (symbol, horizon, day, target_day, actual and ``columns``; rows without a target serve as the last ones).

    Each purged fold and the final fit are independent tasks. The weight is the
    slope of what happened on what the folds forecast for their test rows, and the
    widths are quantiles of their errors over volatility; neither is a score of the
    final fit. ``state`` says what is wrong with a group: it has too few labelled or
    tested rows, or numbers that are not finite.
    """
    columns = list(columns)
    keep = list(dict.fromkeys(["actual", *columns, volatility]))
    known = rows.where("actual IS NOT NULL AND target_day IS NOT NULL").select(*_KEYS, "day", "target_day", *keep)
    folds = fold_rows(known, keep=keep)
    last = rows.groupBy(*_KEYS).agg(F.max_by(F.struct("day", "target_day", *keep), "day").alias("r")).select(*_KEYS, F.lit(FINAL).alias("fold"), "r.day", "r.target_day", F.lit("latest").alias("part"), *(F.col(f"r.{c}").alias(c) for c in keep))
    final = known.select(*_KEYS, F.lit(FINAL).alias("fold"), "day", "target_day", F.lit("train").alias("part"), *keep).unionByName(last)
    parts = folds.where("part != 'purged'").unionByName(final)
    enough = parts.where("part = 'train'").groupBy(*_KEYS, "fold").count().where("count >= 100").drop("count")
    fitted = dealt(parts.join(enough, [*_KEYS, "fold"], "left_semi"), *_KEYS, "fold").groupBy(*_KEYS, "fold").applyInPandas(lambda g: _fit(g, columns, volatility), _FIT)
    fitted = saved(fitted)

    tested = fitted.where(F.col("fold") != FINAL).select(*_KEYS, F.col("weight").alias("fold_weight"), F.explode(F.arrays_zip("actual", "raw", "scale")).alias("t")).select(*_KEYS, "fold_weight", "t.*")
    s = tested.groupBy(*_KEYS).agg(F.count("*").alias("tested_rows"), F.regr_slope("actual", "raw").alias("b"), F.regr_sxx("actual", "raw").alias("sxx"))
    clipped = F.when(F.col("sxx") < 1e-18, 0.0).otherwise(F.least(F.greatest("b", F.lit(0.0)), F.lit(1.0)))
    s = s.select(*_KEYS, "tested_rows", clipped.alias("w"))
    better = F.avg(F.pow(F.col("actual") - F.col("w") * F.col("raw"), 2.0)) < F.avg(F.col("actual") * F.col("actual"))
    weights = tested.join(s, _KEYS).groupBy(*_KEYS, "tested_rows").agg(F.when(better, F.first("w")).otherwise(0.0).alias("weight"))
    errors = F.abs(F.col("actual") - F.col("weight") * F.col("raw")) / F.col("scale")
    widths = tested.join(weights, _KEYS).groupBy(*_KEYS).agg(F.percentile(errors, list(QUANTILES)).alias("errors"))
    m = served_metrics(tested.select(*_KEYS, "actual", (F.col("fold_weight") * F.col("raw")).alias("pred"), F.col("fold_weight").alias("weight")), _KEYS)
    m = m.select(*_KEYS, F.struct("mae", "rmse", "bias", "direction", "active_fraction", "skill_mae", "skill_mse").alias("metrics"))
    ready = fitted.where(F.col("fold") == FINAL).drop("fold", "weight", "actual", "raw", "scale")
    made = rows.select(*_KEYS).distinct().join(ready, _KEYS, "left").join(weights, _KEYS, "left").join(widths, _KEYS, "left").join(m, _KEYS, "left")
    finite = lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = finite("mean") & finite("sd") & F.forall("sd", lambda v: v > 0) & finite(F.flatten("networks")) & finite("errors") & F.col("weight").between(0, 1)
    state = F.when(F.coalesce("training_rows", F.lit(0)) < least_rows, "too few labelled rows").when(F.coalesce("tested_rows", F.lit(0)) < least_tested, "too few tested rows").when(~F.coalesce(sound, F.lit(False)), "not finite").otherwise("ok")
    return made.withColumns({"features": F.array(*map(F.lit, columns)), "volatility": F.lit(volatility), "state": state, "latest": F.col("weight") * F.col("latest")})


def fingerprint(rows: DataFrame) -> str:
    """A hash of all rows, whatever their order."""
    r = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return f"{r[0]}-{r[1]}"


def train_decision(releases: Releases, data: str, matured: int, least_new: int = 60) -> str:
    """Why to train, or why not: ``no model``, ``same data``, ``too few new labels`` since the current version, or ``train``."""
    state = releases.state()
    if state["current"] is None:
        return "no model"
    about = state["versions"][state["current"]]["about"]
    if about.get("data") == data:
        return "same data"
    return "train" if matured - about.get("matured", 0) >= least_new else "too few new labels"


def publish(artifact: DataFrame, releases: Releases, name: str, about: dict[str, Any]) -> str:
    """Publish a candidate; ValueError, and nothing is published, if no group of it can serve. It is served once it is promoted."""
    artifact = saved(artifact)
    if not artifact.where("state = 'ok'").limit(1).count():
        raise ValueError("no symbol and horizon could be trained")
    releases.publish(artifact.coalesce(1), name, about | {"status": "REVIEW_REQUIRED"})
    return name


def review(releases: Releases, name: str) -> DataFrame:
    """(symbol, horizon, champion, candidate, better) of the mean absolute errors, where both have them; without a champion that side is null."""
    champion = releases.state()["champion"]
    mae = lambda n: releases.read(n).where("state = 'ok'").select(*_KEYS, "metrics.mae")
    candidate = mae(name).withColumnRenamed("mae", "candidate")
    held = mae(champion).withColumnRenamed("mae", "champion") if champion else candidate.select(*_KEYS, F.lit(None).cast("double").alias("champion"))
    return candidate.join(held, _KEYS, "left").select(*_KEYS, "champion", "candidate", (F.col("candidate") <= F.col("champion")).alias("better"))


class BadArtifact(ValueError):
    """A stored version that does not fit the columns it is to read."""


def load(releases: Releases, columns: Sequence[str]) -> DataFrame:
    """The rows of the champion that can serve; BadArtifact if its bytes have changed or it reads other columns."""
    name = releases.state()["champion"]
    if name is None:
        raise BadArtifact("no version has been promoted")
    if not releases.intact(name):
        raise BadArtifact(f"{name}: its bytes are not those that were published")
    rows = releases.read(name).where("state = 'ok'").withColumn("version", F.lit(name))
    wrong = rows.where((F.col("features") != F.array(*map(F.lit, columns))) | (F.size("mean") != len(columns)) | (F.size("sd") != len(columns)))
    if wrong.limit(1).count():
        raise BadArtifact(f"{name}: it reads other columns")
    return rows


_SERVED = "version string, symbol string, horizon int, day date, base double, mean double, price double, error double, disagreement double, weight double, confident boolean, clipped array<string>, status string, effects map<string,double>"


def serve(artifact: DataFrame, rows: DataFrame, columns: Sequence[str], neutral: Sequence[str] = ()) -> DataFrame:
    """Forecasts of ``rows`` (symbol, day, price and ``columns``) for every horizon of the artifact.

    Columns in ``neutral`` count as their training mean. ``effects`` is what each
    column adds over its mean, ``disagreement`` the deviation between the networks;
    columns beyond 6 deviations are clipped and named, and the row is out of
    distribution. Rows with an unknown column or price, and symbols without an
    artifact, are left out.
    """
    columns = list(columns)
    known = rows.dropna(subset=[*columns, "price"]).where("price > 0").select("symbol", "day", F.col("price").alias("base"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    out = [i for i, c in enumerate(columns) if c in neutral]
    met = known.join(artifact.select("version", *_KEYS, F.col("mean").alias("m"), "sd", "networks", "weight", "errors", "usual_volatility", "volatility"), "symbol")

    def forecast(batches):
        for part in batches:
            made = []
            for r in part.itertuples(index=False):
                raw = (np.array(r.x) - r.m) / r.sd
                z = np.clip(raw, -fits.CLIP, fits.CLIP)
                z[out] = 0.0
                neutral_rows = np.repeat(z[None], len(z), axis=0)
                np.fill_diagonal(neutral_rows, 0.0)
                members = np.array([fits.network_told(np.array(w), np.vstack([z[None], neutral_rows])) for w in r.networks])
                told, mean = members[:, 0], r.weight * members[:, 0].mean()
                scale = float(_volatility_scale(np.array([r.x[columns.index(r.volatility)]]), r.usual_volatility)[0])
                clipped = [c for c, v in zip(columns, raw, strict=True) if abs(v) > fits.CLIP]
                effects = dict(zip(columns, (r.weight * (told.mean() - members[:, 1:].mean(axis=0))).tolist(), strict=True))
                made.append((r.version, r.symbol, r.horizon, r.day, r.base, mean, r.base * (1 + mean), r.errors[QUANTILES.index(0.8)] * scale, float((r.weight * told).std()), r.weight, r.weight >= CONFIDENT, clipped, "OUT_OF_DISTRIBUTION" if clipped else "OK", effects))
            yield pd.DataFrame(made, columns=[c.split()[0] for c in _SERVED.replace("map<string,double>", "m").split(", ")])

    return met.mapInPandas(forecast, _SERVED)
