"""Train, publish, load and serve: the stored artifact gives the trainer's own forecasts, and gates hold."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import fits
from tideline.operators import training as ops
from tideline.sources.publication import Releases

X = ["a", "b", "vol"]


def frame(n=420, seed=1, symbols=("S", "T")):
    out = []
    for k, symbol in enumerate(symbols):
        g = np.random.default_rng(seed + k)
        x = g.normal(size=(n, 3))
        x[:, 2] = np.abs(x[:, 2]) + 0.1
        y = 0.02 * np.tanh(x[:, 0]) + 0.01 * g.normal(size=n)
        day = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
        for h in (7, 14):
            due = [d + dt.timedelta(days=h) for d in day]
            out += [(symbol, h, d, e if i < n - h else None, float(v) if i < n - h else None, 100.0 + i, *map(float, r)) for i, (d, e, v, r) in enumerate(zip(day, due, y, x, strict=True))]
    return out


SCHEMA = "symbol string, horizon int, day date, target_day date, actual double, price double, a double, b double, vol double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(frame() + frame(60, symbols=("U",)), SCHEMA)


@pytest.fixture(scope="module")
def releases(spark, rows, tmp_path_factory):
    r = Releases(spark, str(tmp_path_factory.mktemp("models")))
    ops.publish(ops.train(rows, X, "vol"), r, "v1", {"data": ops.fingerprint(rows), "matured": 800})
    r.promote("v1")
    return r


def test_stored_artifact_serves_the_trainers_forecasts(releases, rows):
    p = rows.toPandas()
    stored = {(r.symbol, r.horizon): r for r in releases.read("v1").collect()}
    assert {k: r.state for k, r in stored.items()} == {(s, h): "ok" if s != "U" else "too few labelled rows" for s in "STU" for h in (7, 14)}
    last = rows.groupBy("symbol").agg(F.max("day").alias("day"))
    served = {(r.symbol, r.horizon): r for r in ops.serve(ops.load(releases, X), rows.where("horizon = 7").join(last, ["symbol", "day"]), X).collect()}
    assert set(served) == {(s, h) for s in "ST" for h in (7, 14)}
    for key, r in served.items():
        g = p[(p.symbol == key[0]) & (p.horizon == key[1])].sort_values("day")
        known = g.dropna(subset=["actual"])
        x, y = known[X].to_numpy(), known["actual"].to_numpy()
        scale = fits.scaler(x)
        z, new = fits.scaled(x, *scale), fits.scaled(g[X].tail(1).to_numpy(), *scale)
        own = np.array([fits.network_told(fits.fit_network(z, y, seed)[0], new)[0] for seed in fits.SEEDS])
        a = stored[key]
        assert r.mean == pytest.approx(a.weight * own.mean(), abs=1e-12) and r.mean == pytest.approx(a.latest, abs=1e-12)
        assert r.disagreement == pytest.approx((a.weight * own).std(), abs=1e-12)
        assert r.price == pytest.approx(g.price.iloc[-1] * (1 + r.mean)) and r.confident == (a.weight >= 0.2) and a.weight > 0.3
        usual = known.vol.median()
        assert r.error == pytest.approx(a.errors[2] * np.clip(g.vol.iloc[-1] / usual, 0.75, 2))
        for i, c in enumerate(X):  # a column's effect: the forecast less the one with it at its mean
            at = new.copy()
            at[0, i] = 0
            without = np.mean([fits.network_told(fits.fit_network(z, y, seed)[0], at)[0] for seed in fits.SEEDS])
            assert r.effects[c] == pytest.approx(a.weight * (own.mean() - without), abs=1e-12)
        assert a.tested_rows == len(known) - int(len(known) * 0.55) and a.training_rows == len(known)
        assert a.metrics.skill_mae > 0 and a.errors == sorted(a.errors)


def test_inputs_out_of_range_or_unknown(releases, rows, spark):
    odd = spark.createDataFrame([("S", dt.date(2022, 1, 1), 50.0, 1e6, 0.0, 0.5), ("S", dt.date(2022, 1, 2), 50.0, None, 0.0, 0.5), ("S", dt.date(2022, 1, 3), 0.0, 0.0, 0.0, 0.5), ("X", dt.date(2022, 1, 1), 50.0, 0.0, 0.0, 0.5)], "symbol string, day date, price double, a double, b double, vol double")
    got = ops.serve(ops.load(releases, X), odd, X).collect()
    assert {(r.horizon, r.status, tuple(r.clipped)) for r in got} == {(7, "OUT_OF_DISTRIBUTION", ("a",)), (14, "OUT_OF_DISTRIBUTION", ("a",))}
    calm = ops.serve(ops.load(releases, X), odd.limit(1), X, neutral=["a"]).collect()
    assert all(r.effects["a"] == 0 for r in calm) and all(abs(c.mean) < abs(r.mean) for c, r in zip(sorted(calm, key=lambda r: r.horizon), sorted(got, key=lambda r: r.horizon), strict=True))


def test_gates(releases, rows, spark, tmp_path):
    with pytest.raises(ops.BadArtifact, match="other columns"):
        ops.load(releases, ["b", "a", "vol"])
    empty = Releases(spark, str(tmp_path))
    with pytest.raises(ops.BadArtifact, match="promoted"):
        ops.load(empty, X)
    with pytest.raises(ValueError, match="could be trained"):
        ops.publish(ops.train(rows.where("symbol = 'U'"), X, "vol"), empty, "none", {})
    assert empty.state()["current"] is None
    data = ops.fingerprint(rows)
    assert data == ops.fingerprint(rows.repartition(5)) and data != ops.fingerprint(rows.where("horizon = 7"))
    assert ops.train_decision(empty, data, 0) == "no model" and ops.train_decision(releases, data, 5000) == "same data"
    assert ops.train_decision(releases, "other", 850) == "too few new labels" and ops.train_decision(releases, "other", 860) == "train"


def test_challenger_beside_the_champion(releases, spark, rows):
    shuffled = rows.withColumn("a", F.rand(3))  # what tells the target is gone
    ops.publish(ops.train(shuffled, X, "vol"), releases, "v2", {"data": "other"})
    got = ops.review(releases, "v2").collect()
    assert len(got) == 4 and not any(r.better for r in got)
    assert all(r.candidate == r.champion for r in ops.review(releases, "v1").collect())
    assert releases.state()["champion"] == "v1" and releases.state()["current"] == "v2"
    assert releases.retain(1) == [] and set(releases.state()["versions"]) == {"v1", "v2"}


def test_unlabelled_table(spark):
    none = ops.train(spark.createDataFrame([], SCHEMA), X, "vol")
    assert none.count() == 0
