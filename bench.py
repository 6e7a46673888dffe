"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, ROOT)

HEADLINES = (
    "gold_features_daily resample_weekly price_table macro_asof macro_change_ratio pit_features forward_labels feature_table walk_forward_splits "
    "metric_summary interval_coverage monitoring_windows ledger_summary level_ladder cluster_single_linkage trend_lines regression_channel_250 oscillators "
    "ema_macd atr_adx momentum_frames intraday_momentum block_bootstrap mlp_walk_forward jaccard_pairs keyword_clusters number_audit stream_bars"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    from tideline.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["resample_weekly"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the JVM warms up
    times = {}
    for name in HEADLINES:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total wall-clock of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
