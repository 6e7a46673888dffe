"""Gates and products on odd inputs."""

import json

from pyspark.sql import functions as F

from tideline.operators import products
from tideline.sources import feeds


def test_gates_fail_closed(spark):
    good = {"provenance": {"validated": True, "availability": "point_in_time", "macro_vintage": "point_in_time", "price_instrument": "XAUUSD_spot"}}
    told = [json.dumps(good), json.dumps({"provenance": good["provenance"] | {"validated": None}}), "{}", "no json", None]
    rows = spark.createDataFrame(list(enumerate(told)), "id int, m string")
    assert [r.ready for r in rows.select("id", products.promotion_ready(F.col("m")).alias("ready")).orderBy("id").collect()] == [True, False, False, False, False]
    art = {"features": ["a", "b"], "mean": [1, 2], "spread": [1, 2], "weight": 0.5}
    told = [art, art | {"features": ["b", "a"]}, art | {"mean": [1]}, art | {"spread": [1, 0]}, art | {"weight": 2}, art | {"weight": None}, {}]
    rows = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(told)] + [(7, None)], "id int, a string")
    assert [r.p for r in rows.select("id", products.artifact_problem(F.col("a"), ("a", "b")).alias("p")).orderBy("id").collect()] == [None, "features", "scaler", "spread", "weight", "weight", "features", "features"]


def test_slots(spark):
    of = lambda xs: spark.range(1).select(products.slots(F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>"), ("a", "b", "c", "x"), ("a", "b", "c"), 3).alias("s")).select("s", products.put_first(F.col("s"), "b").alias("f")).first()
    assert tuple(of([])) == (["a", "b", "c"], ["b", "a", "c"])
    assert tuple(of(["x", "x", "zz", "c"])) == (["x", "c", "a"], ["b", "c", "a"])


def test_snapshot_tells_what_failed(spark):
    stored = spark.createDataFrame([("a", "2024-01-01", 5.0, 20), ("b", "2024-01-01", 6.0, 3)], "symbol string, day string, close double, n long")
    live = spark.createDataFrame([("a", 5.5)], "symbol string, live double")
    vendor = spark.createDataFrame([], "symbol string, vendor double")
    got = {r.symbol: (r.price, r.origin, r.vendor, r.warnings) for r in products.snapshot(stored, live, vendor).collect()}
    assert got == {"a": (5.5, "live", None, ""), "b": (6.0, "stored", None, "live quote,history")}


def test_a_failing_series_does_not_stop_the_others(spark):
    lines = spark.createDataFrame([("a", "p", "2024-01-01,1.5"), ("a", "p", "bad"), ("a", "q", "2024-01-01,9"), ("b", "p", "<html>"), ("b", "q", "2024-02-01,2"), ("c", "p", "x"), ("z", "p", "2024-01-01,1")], "series string, source string, line string")
    lags = spark.createDataFrame([("a", 10), ("b", 2), ("c", 1), ("d", 1)], "series string, lag_days int")
    store, errors = feeds.macro_store(lines, ["p", "q"], lags)
    assert sorted((r.series, r.value, r.source, str(r.available_at)[:10]) for r in store.collect()) == [("a", 1.5, "p", "2024-01-11"), ("b", 2.0, "q", "2024-02-03")]
    assert sorted((r.series, r.failed, r.used) for r in errors.collect()) == [("b", "p", "q"), ("c", "p,q", None), ("d", "p,q", None)]


def test_csv_with_quoted_fields(spark):
    header = '"Top, queries",Clicks,"Position"'
    lines = spark.createDataFrame([(1, header), (2, '"gold, price",12,"3,4"'), (3, "plain,5"), (4, '"with ""quotes""",,7')], "n int, line string")
    got = feeds.csv_columns(lines, "line", header, {"query": ["query", "top, queries"], "clicks": ["clicks"], "position": ["position"], "none": ["other"]}, ["n"])
    assert [tuple(r) for r in got.orderBy("n").collect()] == [(2, "gold, price", "12", "3,4", None), (3, "plain", "5", None, None), (4, 'with "quotes"', None, "7", None)]
