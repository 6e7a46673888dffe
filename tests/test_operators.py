"""Small cases whose results are known by hand."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tideline.functions import kernels, numeric, text
from tideline.plans import evaluation
from tideline.operators import asof, bars, dedupe, evaluate, features, levels, windows
from tideline.sources import feeds, sinks
from tideline.streaming import feeds as streams


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_week_label_and_completion(spark):
    b = spark.createDataFrame([("x", day(i), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, 1.0) for i in range(9)], "symbol string, day date, open double, high double, low double, close double, volume double")
    rows = {r.label: r for r in bars.resample(b, bars.week_ending_friday(F.col("day"))).collect()}
    assert rows[day(4)].open == 1.0 and rows[day(4)].close == 5.5 and rows[day(4)].volume == 5.0
    assert set(rows) == {day(4), day(11)}
    # an ISO week is complete on its Saturday
    assert bars.last_complete(b, "week", F.lit(day(5))).count() == 1
    assert bars.last_complete(b, "week", F.lit(day(4))).count() == 0


def test_ohlc_violations_catch_nulls_and_nan(spark):
    b = spark.createDataFrame([("x", 2.0, 1.0, 1.5), ("x", 2.0, 1.0, 2.5), ("x", None, 1.0, 1.5), ("x", math.nan, 1.0, 1.5), ("x", math.inf, 1.0, 1.5)], "symbol string, high double, low double, close double")
    assert bars.ohlc_violations(b).count() == 4


def test_full_outer_carries_over_years(spark):
    s = spark.createDataFrame([(dt.date(2023, 12, 30), 10.0)], "day date, spot double")
    f = spark.createDataFrame([(dt.date(2023, 12, 30), 11.0), (dt.date(2024, 1, 2), 12.0)], "day date, futures double")
    rows = {r.day: r for r in bars.full_outer(s, f).collect()}
    assert rows[dt.date(2024, 1, 2)].basis is None and abs(rows[dt.date(2024, 1, 2)].basis_filled - 1.1) < 1e-12


def test_asof_edges(spark):
    o = spark.createDataFrame([("s", day(5), 1.0), ("s", day(8), None), ("s", day(9), 2.0)], "series string, day date, value double")
    p = spark.createDataFrame([("s", day(i)) for i in (4, 5, 8, 9, 10)], "series string, day date")
    back = {r.day: r.value for r in asof.backward(p, o, ["series"], "day", "value").collect()}
    assert back == {day(4): None, day(5): 1.0, day(8): 1.0, day(9): 2.0, day(10): 2.0}
    ahead = {r.day: r.value for r in asof.forward(p, o, ["series"], "day", "value").collect()}
    assert ahead == {day(4): 1.0, day(5): 1.0, day(8): 2.0, day(9): 2.0, day(10): None}


def test_point_in_time_prefers_latest_observation_then_vintage(spark):
    ts = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    o = spark.createDataFrame([("s", day(0), ts(10), 1.0), ("s", day(0), ts(40), 1.5), ("s", day(20), ts(30), 2.0)], "series string, obs_date date, available_at timestamp, value double")
    p = spark.createDataFrame([("s", ts(5), day(25)), ("s", ts(15), day(25)), ("s", ts(35), day(25)), ("s", ts(50), day(10))], "series string, known_at timestamp, cutoff date")
    got = {(r.known_at, r.cutoff): r.value for r in asof.point_in_time(p, o, ["series"], "known_at", "cutoff").collect()}
    assert got == {(ts(5), day(25)): None, (ts(15), day(25)): 1.0, (ts(35), day(25)): 2.0, (ts(50), day(10)): 1.5}


def test_features_do_not_see_the_future(spark):
    g = np.random.default_rng(1)
    c = 100 * np.exp(np.cumsum(g.normal(0, 0.01, 120)))
    full = pd.DataFrame({"symbol": "x", "day": [day(i) for i in range(120)], "open": c, "high": c * 1.01, "low": c * 0.99, "close": c, "volume": 1.0})
    a = windows.gold_features(spark.createDataFrame(full.iloc[:100])).orderBy("day").toPandas()
    b = windows.gold_features(spark.createDataFrame(full)).orderBy("day").toPandas().iloc[: len(a)]
    assert len(a) == 40
    pd.testing.assert_frame_equal(a, b)


def test_cone_of_published_fixture():
    spread = 1.2815515655446004 * 0.01464 * math.sqrt(21)
    assert abs(4386.25 * math.exp(-spread) - 4024.81) < 0.5 and abs(4386.25 * math.exp(spread) - 4780.15) < 0.5


def test_kernels():
    c = pd.Series([1.0, 2, 3, 4, 5] * 6)
    assert kernels.rsi_seeded(c).isna().sum() == 14
    assert kernels.rsi_seeded(pd.Series(np.ones(20))).iloc[-1] == 50 and kernels.rsi_seeded(pd.Series(range(1, 21), dtype=float)).iloc[-1] == 100
    assert kernels.rsi_seeded(pd.Series([1.0])).isna().all()
    assert math.isnan(kernels.adx_sums(pd.DataFrame({"high": [1.0], "low": [1.0], "close": [1.0]})))


def test_direction_is_unknown_before_it_begins():
    """The first bar has no direction; the index begins with the first that has one, and is smoothed by a fourteenth."""
    b = pd.DataFrame({"day": [day(i) for i in range(20)], "high": [10.0, 11, 12, 11.5] + [12.0 + i for i in range(16)], "low": [9.0, 10, 11, 9.5] + [11.0 + i for i in range(16)], "close": [9.5, 10.5, 11.5, 10.0] + [11.5 + i for i in range(16)]})
    i = kernels.indicators(b)
    assert math.isnan(i.adx[0]) and i.adx[1] == 100 and i.adx[2] == 100
    plus, minus = 1 / 14 * (1 - 1 / 14) ** 2 + 1 / 14 * (1 - 1 / 14), 1.5 / 14
    assert i.adx[3] == pytest.approx(100 + (100 * abs(plus - minus) / (plus + minus) - 100) / 14)
    assert i.rsi_ewm.isna().sum() == 14 and i.atr[0] == 1.0 and i.plus_di[0] == 0


def test_break_score_and_zones(spark):
    moves = spark.createDataFrame([("x", 100.0, 0.02, 64.0), ("y", 100.0, 0.0, 64.0)], "symbol string, close double, move double, strength double")
    l = spark.createDataFrame([("x", "near", 101.0), ("x", "far", 108.0), ("x", "at", 100.0), ("y", "near", 101.0)], "symbol string, name string, price double")
    got = {(r.symbol, r.name): (r.reach, r.score, r.label) for r in levels.break_potential(l, moves).collect()}
    assert got[("x", "near")] == (pytest.approx(2.0), pytest.approx(0.8), "strong") and got[("x", "far")] == (pytest.approx(0.25), pytest.approx(0.4), "medium")
    assert got[("x", "at")] == got[("y", "near")] == (None, None, None)
    f = spark.createDataFrame([("x", 100.0, 0.1, 0.05, 0.01)], "symbol string, close double, mean double, error double, atr double")
    z = levels.trade_zones(f, 10_000.0, 2.0).first()
    assert (z.near, z.band, z.buy_low, z.buy_high, z.sell_low, z.sell_high) == tuple(map(pytest.approx, (110, 5, 106.4, 108.1, 111.75, 113.6)))
    assert (z.entry, z.stop, z.units) == tuple(map(pytest.approx, (107.25, 104.9, 200 / 2.35)))


def test_quotes_are_checked(spark):
    q = spark.createDataFrame([(1, 99.0, 100.0, 90.0, 110.0, 95.0), (2, 99.0, 100.0, 5.0, 110.0, 95.0), (3, 99.0, 100.0, 90.0, 110.0, 70.0), (4, 99.0, 120.0, 90.0, 110.0, 95.0)], "id int, bid double, ask double, low double, high double, previous double")
    got = {r.id: (r.has_range, r.position, r.change) for r in levels.read_quotes(q).collect()}
    assert got[1] == (True, 50.0, pytest.approx(100 / 95 - 1)) and got[2] == got[4] == (False, None, None) and got[3] == (True, 50.0, None)


def test_live_levels_touch_and_cross(spark):
    l = spark.createDataFrame([("x", n, p) for n, p in (("a", 90.0), ("b", 99.5), ("c", 101.0), ("d", 103.0), ("e", 110.0))], "symbol string, name string, price double")
    live = spark.createDataFrame([("x", 100.5, 102.5, 0.6)], "symbol string, close double, live double, margin double")
    got = {(r.name, r.role): r.rank for r in levels.live_levels(l, live).collect()}
    assert got == {("a", "support"): 3, ("b", "support"): 2, ("c", "support"): 1, ("c", "crossed"): 1, ("d", "touching"): 1, ("e", "resistance"): 1}


def test_clusters_differ_by_rule(spark):
    rows = [("x", float(p), 1, f"n{i}") for i, p in enumerate((100, 101, 102, 103, 110))]
    l = spark.createDataFrame(rows, "symbol string, price double, priority int, name string")
    assert sorted(r.n for r in levels.cluster(l, F.lit(1.5)).collect()) == [1, 4]
    l = l.select("symbol", "price", "name", F.lit(2.0).alias("weight"), F.lit(1).alias("touches"))
    got = levels.merged(l, spark.createDataFrame([("x", 1.2)], "symbol string, tolerance double")).orderBy("cluster").collect()
    assert [(r.n, r.price, r.score) for r in got] == [(2, 100.5, 4.0), (2, 102.5, 4.0), (1, 110.0, 2.0)]


def test_frozen_needs_sixteen_known_values(spark):
    rows = [("a", day(i), 5.0, 1.0 if i else None, float(i)) for i in range(16)] + [("b", day(i), 5.0, 1.0, 1.0) for i in range(15)]
    got = {(r.symbol, r.feature): r.frozen for r in features.frozen(spark.createDataFrame(rows, "symbol string, day date, f double, g double, h double"), ["f", "g", "h"]).collect()}
    assert got[("a", "f")] and not got[("a", "g")] and not got[("a", "h")] and not got[("b", "f")]


def test_metrics_leave_out_abstentions(spark):
    p = spark.createDataFrame([("a", 1.0, 1.0, 10.0), ("a", 0.0, 1.0, 10.0), ("a", 1.0, 0.0, 10.0), ("a", -1.0, 1.0, 10.0), ("a", -1.0, -1.0, 10.0)], "k string, pred double, actual double, price double")
    r = evaluate.metrics(p, ["k"]).first()
    assert r.n == 5 and r.direction == pytest.approx(2 / 3) and r.direction_all == 0.4 and r.active_direction == 0.5 and r.active_fraction == 0.8
    assert r.balanced_direction == 0.75 and r.within_2 == 0.4 and r.price_mae == 8.0 and r.always_up == 0.6
    served = evaluate.served_metrics(p.withColumn("weight", F.when(F.col("pred") < 0, 0.1).otherwise(0.5)), ["k"]).first()
    assert served.active_fraction == 0.6 and served.directional_rows == 1 and served.direction == 1.0


def test_monitoring_alerts_and_drift(spark):
    """Thirty outcomes that do worse than no forecast are an alert; the drift needs a whole window before."""
    rows = [("x", "v", 7, i + 1, 100.0, 110.0, 90.0, 120.0, 100.0 + (i % 2), i % 2 == 0, 0.01) for i in range(60)] + [("y", "v", 7, i + 1, 100.0, 101.0, 90.0, 120.0, 102.0, True, 0.0) for i in range(40)]
    r = spark.createDataFrame(rows, "instrument string, version string, horizon int, rank int, base double, p50 double, p10 double, p90 double, price double, has_view boolean, disagreement double")
    got = {(x.instrument, x.window): x for x in evaluate.monitoring(r).collect()}
    assert got[("x", 30)].alert and got[("x", 30)].drift == pytest.approx(0) and got[("x", 90)].drift is None and got[("x", 30)].resolved == 30
    assert got[("x", 30)].directional == 0 and not got[("y", 30)].alert and got[("y", 30)].drift is None and got[("y", 30)].direction == 1.0


def test_adaptive_widths_wait_for_maturity():
    """A row's miss counts once its target has matured, and never before."""
    days = np.array([np.datetime64("2024-01-01") + np.timedelta64(i, "D") for i in range(6)])
    targets = days + np.timedelta64(2, "D")
    calibration, error = np.arange(1.0, 10.0), np.array([100.0, 0, 0, 0, 0, 0])
    rolling, adaptive, alpha = evaluation.adaptive_widths(calibration, error, days, targets, 0.8)
    # rank min(n, ceil((n + 1) 0.8)): 8 of 9; from the fourth row on, one more score is known
    assert rolling.tolist() == [8, 8, 8, 9, 9, 9] and adaptive[:3].tolist() == [8, 8, 8]
    assert alpha == pytest.approx(0.2 + 0.01 * (0.2 - 1) + 2 * 0.01 * 0.2)
    assert math.isnan(evaluation.adaptive_widths(np.zeros(0), error, days, targets, 0.8)[0][0])


def test_shrunk_covariance_and_its_threshold(spark):
    """Against the estimator's formula on all rows at once, and the 99 % point of the training rows."""
    from tideline.operators import models

    g = np.random.default_rng(2)
    x = g.normal(size=(80, 4)) @ g.normal(size=(4, 4)) + 3
    names = list("abcd")
    train = spark.createDataFrame([("s", i, *map(float, v)) for i, v in enumerate(x)], "symbol string, i int, a double, b double, c double, d double")
    got = models.mahalanobis(train, train, names, ["symbol"], ["symbol", "i"]).orderBy("i").toPandas()
    z = (x - x.mean(0)) / x.std(0)
    cov, n, p = z.T @ z / 80, 80, 4
    mu, norm = np.trace(cov) / p, (cov**2).sum()
    beta = ((z**2).sum(1) ** 2).sum() / n - norm
    delta = (norm - 2 * mu * np.trace(cov) + p * mu * mu) / p
    share = min(beta / (p * n), delta) / delta
    cov = (1 - share) * cov + share * mu * np.eye(p)
    want = np.sqrt(np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    assert np.allclose(got.distance, want) and np.allclose(got.threshold, np.quantile(want, 0.99)) and got.outside.sum() == (want > np.quantile(want, 0.99)).sum()


def test_serving_scales_and_tells(spark):
    from tideline.operators import models

    rows = spark.createDataFrame([("s", 100.0, 2.0, 0.4), ("t", 100.0, 20.0, 0.1)], "symbol string, close double, a double, volatility_20 double")
    members = [([0.01, 0.0], 0.0), ([0.02, 0.0], 0.0)]
    got = {r.symbol: r for r in models.serve(rows, ["a", "volatility_20"], [0.0, 0.2], [2.0, 0.2], members, 0.5, 0.03, 0.2).collect()}
    s, t = got["s"], got["t"]
    assert s.mean == pytest.approx(0.5 * 0.015) and s.disagreement == pytest.approx(0.5 * 0.005) and s.error == pytest.approx(0.06) and s.price == pytest.approx(100.75)
    assert s.clipped == "" and s.status == "OK" and t.clipped == "a" and t.status == "OUT_OF_DISTRIBUTION" and t.error == pytest.approx(0.0225) and t.mean == pytest.approx(0.5 * 0.015 * 6)


def test_bootstrap_of_a_constant_error(spark):
    rows = [("a", day(i), 1.0 if i % 2 else -1.0, 2.0 if i % 2 else -2.0) for i in range(70)]
    r = evaluate.block_bootstrap(spark.createDataFrame(rows, "symbol string, day date, pred double, actual double"), ("symbol",), reps=20).first()
    assert (r.n, r.mae_low, r.mae_high, r.direction_low, r.skill_high) == (70, pytest.approx(1), pytest.approx(1), 1.0, pytest.approx(0.5))


def test_conformal_rank(spark):
    s = spark.createDataFrame([("a", float(i)) for i in range(1, 10)], "k string, score double")
    assert evaluate.conformal(s, ["k"], 0.8).first().width == 8.0
    assert evaluate.conformal(s, ["k"], 0.99).first().width == 9.0


def test_pairs_are_judged_where_they_meet(spark):
    g = np.random.default_rng(5)
    titles = [" ".join(f"word{w}" for w in set((g.zipf(1.4, int(g.integers(1, 12))) % 25).tolist())) for _ in range(300)]
    sets = {}
    for i, t in enumerate(titles):
        sets.setdefault(frozenset(t.split()), i // 2)  # two titles share an id
    of = [(i, w) for w, i in sets.items()]
    want = sorted((i, j, len(v & w) / len(v | w)) for i, v in of for j, w in of if i < j and 10 * len(v & w) >= 6 * len(v | w))
    pairs = dedupe.jaccard_pairs(spark.createDataFrame([(i // 2, t) for i, t in enumerate(titles)], "id long, title string"), 0.6)
    assert sorted(tuple(r) for r in pairs.collect()) == want and len(want) > 50
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan


def test_keep_first_is_order_dependent(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "id long")
    assert sorted(r.id for r in dedupe.keep_first(pairs, ids).collect()) == [1, 3, 5]


@pytest.mark.parametrize(("written", "number"), [("1.234,5", 1234.5), ("1,234.5", 1234.5), ("8,4", 8.4), ("1.240", 1240.0), ("12", 12.0), ("x", None), ("", None)])
def test_parse_number(spark, written, number):
    assert spark.range(1).select(text.parse_number(F.lit(written))).first()[0] == number


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.lower_turkish(F.lit("İIA"))) == "iıa"
    assert one(text.truncate_words(F.lit("aa bb cc"), 6)) == "aa bb…"
    assert one(text.locale_numbers(F.lit("a 1.234,5 b 7"))) == [1234.5, 7.0]
    assert one(text.unsupported_numbers(F.array(F.lit(5.0), F.lit(2024.0), F.lit(100.5), F.lit(400.0)), F.array(F.lit(100.0)))) == [400.0]
    assert one(text.word_set(F.lit("The the a-cat, CAT"))) == ["the", "cat"]


def test_numeric(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(numeric.days_in_month(F.lit("2024-02-10").cast("date"))) == 29
    assert one(numeric.contract_code(F.lit("2024-12-10").cast("date"))) == "Z24"
    assert one(numeric.implied_probability(F.lit(9.0), F.lit(1.0), F.lit(2.0))) == 100.0


def test_chart_payloads(spark):
    good = '{"chart":{"result":[{"timestamp":[86400,172800,259200],"indicators":{"quote":[{"open":[null,2,3],"high":[1.005,2,null],"low":[1,2,3],"close":[1,2,3],"volume":[null,5]}]}}]}}'
    p = spark.createDataFrame([("x", good), ("y", "{broken"), ("z", None)], "s string, payload string")
    b = feeds.chart_bars(p, "payload", ["s"]).orderBy("ts").collect()
    assert [(r.s, r.o, r.v) for r in b] == [("x", 1.0, 0), ("x", 2.0, 5)]
    assert [r.day for r in feeds.chart_days(p, "payload", ["s"]).orderBy("day").collect()] == [dt.date(1970, 1, 2), dt.date(1970, 1, 3)]


def test_ticks_come_in_time_order_hour_by_hour():
    g = np.random.default_rng(3)
    n = 5000
    ticks = pd.DataFrame({"symbol": "x", "event_id": g.permutation(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(g.integers(0, 3000, n) * 60, unit="s"), "value": g.uniform(90, 110, n)})
    hours = list(streams.in_time([ticks[k : k + 70] for k in range(0, n, 70)], run=700))
    assert len(hours) == 50 and max(map(len, hours)) < n / 20 and "symbol" not in hours[0]
    out, now = [], None
    for rows in hours:
        assert rows["ts"].dt.floor("h").nunique() == 1
        said, now = streams.decide(rows, now)
        out += said
    assert (out, now) == streams.decide(ticks, None) and len(out) > 10


def test_checksums_wrap(spark):
    most = 2**63 - 1
    rows = spark.createDataFrame([(1, most), (1, most), (2, most), (2, 1), (3, 5), (3, -7), (4, None)], "k int, x long")
    got = dict(rows.groupBy("k").agg(features.wrapped_sum(F.col("x")).alias("s")).collect())
    assert got == {1: -2, 2: -(2**63), 3: -2, 4: None}


def test_chart_payloads_are_parsed_once(spark):
    n = 30000
    payload = json.dumps({"chart": {"result": [{"timestamp": list(range(n)), "indicators": {"quote": [{"high": [1.0] * n, "low": [1.0] * (n - 1), "close": [1.0] * n}]}}]}})
    empty = [json.dumps({"chart": c}) for c in ({"result": []}, {"result": [{"timestamp": [1], "indicators": {"quote": []}}]})]
    p = spark.createDataFrame([(x,) for x in (payload, *empty)], "payload string")
    b = feeds.chart_bars(p, "payload", [])
    assert b._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert b.agg(F.count("*"), F.sum("v")).first()[:] == (n - 1, 0)


def test_series_csv_skips_what_does_not_parse(spark):
    l = spark.createDataFrame([("DATE,X",), ("2024-01-01,.",), ("2024-01-02,1.5",), ("",), (None,)], "line string")
    assert [(r.day, r.value) for r in feeds.series_csv(l, "line", []).collect()] == [(dt.date(2024, 1, 2), 1.5)]


def test_rss(spark):
    xml = "<rss><item><title>Gold - up - Paper</title><link>u</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0300</pubDate></item><item><title><![CDATA[B]]></title><source url='q'>S</source></item></rss>"
    rows = feeds.rss_items(spark.createDataFrame([(1, xml), (2, None)], "f int, xml string"), "xml", ["f"]).orderBy("pos").collect()
    assert [(r.title, r.source) for r in rows] == [("Gold - up", "Paper"), ("B", "S")] and rows[0].ts == dt.datetime(2024, 1, 1, 7)


def test_append_only(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    path = str(tmp_path / "ledger")
    sinks.append_new(rows, path)
    sinks.append_new(rows, path)
    assert sinks.stored(spark, path, "id int, v string").count() == 2
    with pytest.raises(sinks.DuplicateRows):
        sinks.append_once(rows.where("id = 2"), path)
    root = str(tmp_path / "published")
    for v in ("20240101", "20240102"):
        sinks.publish(rows.withColumn("w", F.lit(v)), root, v)
    assert {r.w for r in sinks.current(spark, root).collect()} == {"20240102"}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.publish(rows, root, "20240102")


def test_failover_boundary(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 12) - dt.timedelta(minutes=m)
    rows = [("fresh", t(60), t(1)), ("stale", t(61), t(1)), ("older", t(61), t(90)), ("none", None, None), ("missing", None, t(5))]
    got = {r.symbol: r.source for r in streams.failover(spark.createDataFrame(rows, "symbol string, primary timestamp, fallback timestamp"), "2024-01-01 12:00:00").collect()}
    assert got == {"fresh": "primary", "stale": "fallback", "older": "primary", "none": None, "missing": "fallback"}


def test_trigger_policy_does_not_depend_on_batches():
    g = np.random.default_rng(2)
    t = pd.DataFrame({"event_id": range(300), "ts": pd.date_range("2024-01-01", periods=300, freq="17min"), "value": 100 + np.cumsum(g.normal(0, 0.3, 300))})
    whole, _ = streams.decide(t, None)
    first, state = streams.decide(t.iloc[:123], None)
    rest, _ = streams.decide(t.iloc[123:], state)
    assert whole == first + rest and whole[0][2] == "first" and max(pd.Series([x[0].date() for x in whole]).value_counts()) <= 6


def test_rolling_baselines_of_all_horizons_and_days(spark):
    from tideline.plans import catalog
    from tideline.sources.tables import bars_daily

    sf = "/root/testdata/sf0.001"
    labels = asof.forward_return(bars_daily(spark, sf)).toPandas()
    got = catalog.QUERIES["rolling_baselines_all"](spark, sf).toPandas().set_index(["symbol", "horizon", "day"])
    assert len(got) == len(labels) > 0 and set(labels.horizon) == {7, 14, 30}
    for (symbol, horizon), g in labels.groupby(["symbol", "horizon"]):
        known = g.dropna(subset=["target_day", "target_return"]).sort_values(["target_day", "day"])
        at, y = known.target_day.to_numpy(), known.target_return.to_numpy()
        for d in g.day:
            past, row = y[at < d], got.loc[(symbol, horizon, d)]
            if not len(past):
                assert math.isnan(row["mean"]) and math.isnan(row["rolling"])
            else:
                assert row["mean"] == pytest.approx(past.mean(), abs=2e-6) and row["rolling"] == pytest.approx(past[-126:].mean(), abs=2e-6)
                assert row["majority"] == pytest.approx(np.median(np.abs(past)) * (1 if (past > 0).mean() >= 0.5 else -1), abs=2e-6)


def test_all_series_and_horizons(spark):
    from tideline.plans import catalog
    from tideline.sources.tables import bars_daily

    sf = "/root/testdata/sf0.001"
    q = {n: catalog.QUERIES[n](spark, sf) for n in ("macro_asof", "macro_asof_all", "macro_change_ratio_all", "feature_table", "feature_table_all", "block_bootstrap")}
    seen = q["macro_asof_all"]
    assert seen.select("series").distinct().count() == q["macro_change_ratio_all"].select("series").distinct().count() == 5
    assert seen.count() == 5 * q["macro_asof"].count() and q["macro_asof"].exceptAll(seen).count() == 0
    wide, narrow = q["feature_table_all"], q["feature_table"]
    assert sum(c.endswith("_level") for c in wide.columns) == 5 and wide.count() > 0
    assert wide.select(narrow.columns).exceptAll(narrow).count() == 0
    got = {(r.symbol, r.horizon) for r in q["block_bootstrap"].collect()}
    assert {h for _, h in got} == {7, 14, 30} and len(got) == 3 * len({s for s, _ in got})
    days = bars_daily(spark, sf).agg(F.min("day")).first()[0]
    macro = spark.createDataFrame([(f"s{i:03}", days - dt.timedelta(days=200), 1.0 + i) for i in range(70)], "series string, day date, value double")
    assert sum(c.endswith("_level") for c in features.feature_table(bars_daily(spark, sf), macro).columns) == 70


def test_networks_walk_forward(spark):
    from tideline.plans import catalog, evaluation

    sf = "/root/testdata/sf0.01"
    d = evaluation._design(spark, sf)
    total = {(r.symbol, r.horizon): r.n for r in d.groupBy("symbol", "horizon").agg(F.count("*").alias("n")).collect()}
    got = {(r.symbol, r.horizon): r for r in catalog.QUERIES["mlp_walk_forward"](spark, sf).collect()}
    assert set(got) == set(total) and any(r.folds == 3 for r in got.values())
    for key, r in got.items():
        n = total[key]
        if r.folds == 3:
            assert r.n == n - math.floor(n * 0.55) and 0 <= r.weight <= 1 and 0 <= r.covered_50 <= r.covered_90 <= 1
    # a group with few rows keeps its row
    x = pd.DataFrame({"symbol": ["a"], "horizon": [7], "fold": [2], "part": ["test"], "day": [day(1)], "target_day": [day(9)], "actual": [0.1], "x_volatility_20": [0.2]})
    assert evaluation._mlp(x).n.tolist() == [0]
