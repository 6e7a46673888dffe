"""Neighbour-based information, correlation matrices, and the number audit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import kernels, text
from tideline.operators import evaluate
from tideline.plans import momentum


def test_neighbours_against_all_pairs():
    g = np.random.default_rng(2)
    for n, step in ((5, 0), (60, 0), (300, 0), (300, 0.25)):
        x, y = g.normal(size=n), g.normal(size=n)
        if step:  # ties
            x, y = np.round(x / step) * step, np.round(y / step) * step
        x = np.sort(x)
        d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
        np.fill_diagonal(d, np.inf)
        assert kernels.neighbour_radius(x, y, 3) == pytest.approx(np.sort(d, axis=1)[:, 2])
        radius = np.sort(d, axis=1)[:, 2] * (1 - 1e-9)
        assert kernels._around(x, radius).tolist() == [int((np.abs(x - v) <= r).sum()) for v, r in zip(x, radius, strict=True)]


@pytest.mark.parametrize("rho", [0.0, 0.5, 0.9])
def test_information_of_a_correlated_gaussian(rho):
    g = np.random.default_rng(6)
    x = g.normal(size=4000)
    y = rho * x + np.sqrt(1 - rho * rho) * g.normal(size=4000)
    assert kernels.neighbour_information(x, 100 * y) == pytest.approx(-0.5 * np.log(1 - rho * rho), abs=0.04)
    assert np.isnan(kernels.neighbour_information(x[:3], y[:3]))


def test_correlations_against_pandas(spark):
    g = np.random.default_rng(1)
    p = pd.DataFrame({"s": np.repeat(["a", "b"], 60), "k": np.tile(np.arange(60), 2), "x": g.normal(size=120), "y": g.integers(0, 5, 120).astype(float), "z": 1.0, "c": g.normal(size=120)})
    p.loc[3, "x"] = None
    rows = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in p.itertuples(index=False)], "s string, k long, x double, y double, z double, c double")
    got = {(r.s, r.a, r.b): r for r in evaluate.correlations(rows, ["x", "y", "z", "c"], ["s"], ["k"]).collect()}
    assert len(got) == 12
    for s, own in p.dropna().groupby("s"):
        for a, b in (("x", "y"), ("x", "c"), ("y", "c")):
            r = got[s, a, b]
            assert (r.n, r.pearson, r.spearman) == (len(own), pytest.approx(own[a].corr(own[b])), pytest.approx(own[a].rank().corr(own[b].rank())))
        assert got[s, "x", "z"].pearson is None and got[s, "z", "c"].spearman is None


def test_numbers_without_support(spark):
    pool = F.array(*map(F.lit, (4295.0, -2.28, 4365.5, 86.0, 0.0, 12.34)))
    of = lambda *x: spark.range(1).select(text.unsupported_numbers(F.array(*(F.lit(float(v)) for v in x)), pool).alias("n")).first().n
    assert of(4295, 2.3, 4366, 86, 16, 2026, 50, 52, 100, 200, 250) == []
    assert of(35, 4100, 2019, 2031, 51) == [35.0, 4100.0, 2019.0, 2031.0, 51.0]
    assert of(4320, 4321) == [4321.0] and of(85.95, 86.6) == [86.6]  # within 0.6 %, or 0.06


def test_alignment_reads_the_score_as_reported(spark):
    s = spark.createDataFrame([("a", f, v) for f, v in (("daily", 20.04), ("weekly", 30.0), ("monthly", 30.0))] + [("b", f, v) for f, v in (("daily", -40.0), ("weekly", 10.0), ("monthly", 50.0))] + [("c", f, 30.0) for f in ("daily", "weekly", "monthly")], "symbol string, frame string, score double")
    got = {r.symbol: (r.daily, r.state) for r in momentum.aligned(s).collect()}
    assert got == {"a": (0, "mixed"), "b": (-1, "correction in an uptrend"), "c": (1, "aligned up")}
