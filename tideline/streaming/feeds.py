"""Structured Streaming over tick feeds: tumbling bars, de-duplication, and a stateful trigger policy.

A run reads all that has arrived (``availableNow``), keeps its progress in a
checkpoint, and returns the table that its sink has written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of (event_id, symbol, ts, value); event time has to be a timestamp with zone."""
    raw = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/event[s].parquet")
    return raw.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")


def drained(stream: DataFrame, mode: str, write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """Run the stream over all input and read back what it wrote."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{root}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def bars(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling open-high-low-close bars; ticks later than ``late`` are dropped."""
    at = F.struct("ts", "event_id")
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "symbol")
    g = g.agg(F.min_by("value", at).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", at).alias("c"), F.count("*").alias("v"))
    return g.select("symbol", F.col("window.start").alias("ts"), "o", "h", "l", "c", "v")


def deduplicated(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, if its repetitions arrive within ``late``."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def decide(rows: pd.DataFrame, state: tuple | None, move: float = 0.5, wait: int = 60, longest: int = 240, daily: int = 6) -> tuple[list[tuple], tuple]:
    """Trigger decisions of ticks in time order: a tick marked ``force``, if there is such a column, whatever the limits say; the first tick, a move of ``move`` % after ``wait`` minutes, or ``longest`` minutes without one; ``daily`` a day at most."""
    out = []
    at, price, runs, day = state or (None, None, 0, None)
    rows = rows.sort_values(["ts", "event_id"])
    forced = rows["force"] if "force" in rows else [False] * len(rows)
    for ts, value, force in zip(rows["ts"], rows["value"], forced, strict=True):
        if str(ts.date()) != day:
            day, runs = str(ts.date()), 0
        if runs >= daily and not force:
            continue
        age = None if at is None else (ts.timestamp() - at) / 60
        reason = "force" if force else "first" if age is None else "age" if age >= longest else "move" if age >= wait and abs(value / price - 1) * 100 >= move else None
        if reason:
            at, price, runs = ts.timestamp(), value, runs + 1
            out.append((ts, value, reason))
    return out, (at, price, runs, day)


def in_time(batches: Iterable[pd.DataFrame], run: int = 1 << 16) -> Iterator[pd.DataFrame]:
    """The rows of unordered batches in time order, hour by hour; ticks of one time stay together.

    What is held are runs sorted by themselves, with the columns that decisions need
    and without copies of the whole.
    """
    runs: list[pd.DataFrame] = []
    part: list[pd.DataFrame] = []

    def close() -> None:
        runs.append(pd.concat(part).sort_values(["ts", "event_id"], ignore_index=True))
        part.clear()

    for rows in batches:
        part.append(rows[[c for c in ("event_id", "ts", "value", "force") if c in rows]].copy())
        if sum(map(len, part)) >= run:
            close()
    if part:
        close()
    hours = sorted(set().union(*(r["ts"].dt.floor("h").dropna().unique() for r in runs)))
    starts = [0] * len(runs)
    for edge in [*hours[1:], None]:
        stops = [len(r) if edge is None else int(r["ts"].searchsorted(edge)) for r in runs]
        yield pd.concat([r.iloc[a:b] for r, a, b in zip(runs, starts, stops, strict=True)])
        starts = stops


def triggers(stream: DataFrame) -> DataFrame:
    """Trigger decisions of each symbol, with its state kept between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, now = [], state.get if state.exists else None
        for rows in in_time(batches):
            said, now = decide(rows, now)
            out += said
        state.update(now)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["symbol", "ts", "value", "reason"])

    return stream.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, value double, reason string", "at double, price double, runs int, day string", "append", GroupStateTimeout.NoTimeout)


def failover(last: DataFrame, now: str, stale_minutes: int = 60) -> DataFrame:
    """Which feed to use: the primary one unless its last bar is more than ``stale_minutes`` old and the fallback's is newer.

    ``last`` is (symbol, primary, fallback), times of the last bars; with both
    null the source is null.
    """
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("primary")) / 60
    use = F.when(F.col("primary").isNull() & F.col("fallback").isNull(), F.lit(None)).when(
        F.col("primary").isNull() | ((age > stale_minutes) & (F.coalesce(F.col("fallback") > F.col("primary"), F.lit(False)))), "fallback"
    ).otherwise("primary")
    reason = F.when(F.col("primary").isNull(), "missing").when(age > stale_minutes, "stale").otherwise("fresh")
    return last.select("symbol", use.alias("source"), reason.alias("reason"), F.floor(age).alias("age_minutes"))
