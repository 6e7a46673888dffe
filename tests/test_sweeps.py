"""The bitemporal sweep, running medians and what has matured, against brute force."""

import time
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tideline.functions import kernels
from tideline.operators import asof, features


def test_point_in_time_against_all_pairs(spark):
    g = np.random.default_rng(12)
    start = date(2020, 1, 1)
    observations = []
    for series in ("a", "b", None):
        for day in range(0, 400, 20):
            for _ in range(int(g.integers(0, 4))):  # revisions, in no order, some at one time
                observations.append((series, start + timedelta(days=day), datetime(2020, 1, 1) + timedelta(days=day + int(g.integers(0, 300))), float(g.integers(0, 50))))
    observations += [("a", None, datetime(2020, 1, 2), 1.0), ("a", start, None, 2.0), ("a", start, datetime(2020, 1, 5), None)]
    probes = [(s, datetime(2020, 1, 1) + timedelta(days=int(g.integers(-10, 700))), start + timedelta(days=int(g.integers(-10, 450)))) for s in ("a", "b", "c", None) for _ in range(150)]
    probes += [("a", None, start), ("a", datetime(2020, 5, 1), None), probes[0], probes[0]]
    o = spark.createDataFrame(observations, "series string, obs_date date, available_at timestamp, value double").repartition(4)
    p = spark.createDataFrame(probes, "series string, known_at timestamp, cutoff date").repartition(3)
    got = asof.point_in_time(p, o, ["series"], "known_at", "cutoff")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    want = set()
    for s, known, cutoff in set(probes):
        hits = [(d, at, v) for t, d, at, v in observations if t == s and None not in (d, at, v, known, cutoff) and at <= known and d <= cutoff]
        want.add((s, known, cutoff, *(max(hits) if hits else (None, None, None))))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(probes)) and set(rows) == want


def test_running_median():
    g = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 50, 401):
        x = g.integers(0, 20, n) / 4
        assert kernels.running_median(x) == pytest.approx([np.median(x[: i + 1]) for i in range(n)])
    x = g.normal(size=200_000)
    began = time.process_time()
    kernels.running_median(x[:20_000])
    short = time.process_time() - began
    began = time.process_time()
    kernels.running_median(x)
    assert time.process_time() - began < 40 * short + 0.5  # ten times the rows: a hundred times if it were quadratic


def test_matured_so_far_against_prefixes(spark):
    g = np.random.default_rng(9)
    day = [date(2021, 1, 1) + timedelta(days=int(d)) for d in np.cumsum(g.integers(1, 4, 300))]
    rows = pd.DataFrame({"symbol": "S", "horizon": 7, "day": day, "target_day": [d + timedelta(days=9 - (i % 2)) for i, d in enumerate(day)], "target_return": g.normal(size=300)})
    rows.loc[290:, ["target_day", "target_return"]] = None
    frame = spark.createDataFrame([(r.symbol, r.horizon, r.day, None if pd.isna(r.target_day) else r.target_day, None if pd.isna(r.target_return) else r.target_return) for r in rows.itertuples()], "symbol string, horizon int, day date, target_day date, target_return double")
    got = {r.day: r for r in features.rolling_baselines(frame, last=40).collect()}
    assert len(got) == 300
    known = rows.dropna().sort_values(["target_day", "day"])
    for d in day:
        y = known[known.target_day < d].target_return
        r = got[d]
        if y.empty:
            assert r["mean"] is None and r.rolling is None and r.majority is None
        else:
            side = 1 if (y > 0).mean() >= 0.5 else -1
            assert (r["mean"], r.rolling, r.majority) == pytest.approx((y.mean(), y.tail(40).mean(), side * y.abs().median()))
