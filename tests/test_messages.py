"""The message source: offsets, restarts, and the quotes of odd messages."""

import json

from pyspark.sql import functions as F

from tideline.streaming import messages


def test_restart_neither_loses_nor_repeats(spark, tmp_path):
    path, out, mark = (f"{tmp_path}/{n}" for n in ("messages", "out", "checkpoint"))

    def more(start, stop):
        rows = spark.range(start, stop).select("id", F.concat(F.lit("m"), "id").alias("payload")).repartition(3)
        messages.store(rows, path, ["id"], after=start)

    def run():
        spark.dataSource.register(messages.StoredMessages)
        stream = spark.readStream.format(messages.NAME).option("path", path).option("range", 7).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    more(0, 25)
    assert run() == [(i, f"m{i}") for i in range(25)]
    assert len(run()) == 25  # nothing new
    more(25, 60)
    assert run() == [(i, f"m{i}") for i in range(60)]


def test_quotes_of_odd_messages(spark):
    row = {"alis": "10.5", "satis": 11, "dusuk": None, "yuksek": "x", "kapanis": 9, "tarih": "01-02-2024 10:20:30", "dir": {"satis_dir": "up"}}
    told = [
        json.dumps({"data": {"ALTIN": row, "USD": {"alis": 30, "satis": 31}, "OTHER": row}}),
        json.dumps({"data": {"ALTIN": row | {"satis": 0}, "ONS": {"alis": 2000, "satis": None}, "USDTRY": {"alis": 1, "satis": 2}, "USD": {"alis": 3, "satis": 4}}}),
        json.dumps({"data": {"ATA_YENI": {"alis": "NaN", "satis": 1}, "TEK_YENI": {"alis": 1, "satis": "Infinity"}, "YARIM_YENI": {"alis": -1, "satis": 2}}}),
        "not json", "{}", None,
    ]
    got = messages.quotes(spark.createDataFrame(list(enumerate(told)), "offset long, payload string")).orderBy("offset", "code").collect()
    assert [(r.offset, r.kind, r.code, r.bid, r.ask) for r in got] == [(0, "quote", "ALTIN", 10.5, 11.0), (0, "pair", "USDTRY", 30.0, 31.0), (1, "pair", "USDTRY", 1.0, 2.0), (2, "quote", "YARIM_YENI", -1.0, 2.0)]
    assert (got[0].low, got[0].high, got[0].previous, got[0].clock, got[0].direction) == (0.0, 0.0, 9.0, "10:20:30", "up")
    assert got[1].low is None and got[3].clock == "" and got[3].direction == ""
