"""As-of joins without inequality joins: probes and observations are united, sorted once and filled."""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _united(probes: DataFrame, observations: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    p = probes.select(*by, F.col(at).alias("_at"), F.lit(None).cast(observations.schema[value].dataType).alias("_v"), F.lit(None).cast(observations.schema[at].dataType).alias("_seen"), F.lit(1).alias("_probe"))
    o = observations.where(F.col(value).isNotNull()).select(*by, F.col(at).alias("_at"), F.col(value).alias("_v"), F.col(at).alias("_seen"), F.lit(0).alias("_probe"))
    return p.unionByName(o)


def backward(probes: DataFrame, observations: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """(by, at, value, seen) of each distinct probe: the latest observation at or before it.

    One observation for each key and time is expected; a null value is no
    observation. Probes before the first observation get nulls.
    """
    w = Window.partitionBy(*by).orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    filled = _united(probes.select(*by, at).distinct(), observations, by, at, value)
    filled = filled.withColumns({value: F.last("_v", ignorenulls=True).over(w), "seen": F.last("_seen", ignorenulls=True).over(w)})
    return filled.where("_probe = 1").select(*by, F.col("_at").alias(at), value, "seen")


def forward(probes: DataFrame, observations: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """(by, at, value, seen) of each distinct probe: the first observation at or after it."""
    w = Window.partitionBy(*by).orderBy(F.desc("_at"), "_probe").rowsBetween(Window.unboundedPreceding, 0)
    filled = _united(probes.select(*by, at).distinct(), observations, by, at, value)
    filled = filled.withColumns({value: F.last("_v", ignorenulls=True).over(w), "seen": F.last("_seen", ignorenulls=True).over(w)})
    return filled.where("_probe = 1").select(*by, F.col("_at").alias(at), value, "seen")


def change(days: DataFrame, observations: DataFrame, by: list[str], at: str, value: str, lag_days: int | Column) -> DataFrame:
    """Value as of a day, as of ``lag_days`` calendar days before (a number, or one by the key columns), their difference and their ratio (null over null or 0)."""
    now = backward(days, observations, by, at, value).select(*by, at, value)
    earlier = days.select(*by, F.date_sub(at, lag_days).alias(at))
    then = backward(earlier, observations, by, at, value).select(*by, F.date_add(at, lag_days).alias(at), F.col(value).alias("before"))
    both = now.join(then, [*by, at])
    return both.withColumns({"difference": F.col(value) - F.col("before"), "ratio": F.col(value) / F.nullif(F.col("before"), F.lit(0.0)) - 1})


def _swept(rows: pd.DataFrame) -> pd.DataFrame:
    """One key's observations and probes in the order of availability; observed days are kept sorted, each with its latest vintage."""
    days: list = []
    latest: dict = {}
    out = []
    for probe, known_at, cutoff, value in rows.sort_values(["_at", "_probe", "_day", "_value"])[["_probe", "_at", "_day", "_value"]].itertuples(index=False):
        if not probe:
            if cutoff not in latest:
                insort(days, cutoff)
            latest[cutoff] = (known_at, value)
        else:
            k = bisect_right(days, cutoff)
            out.append((known_at, cutoff, days[k - 1], *latest[days[k - 1]]) if k else (known_at, cutoff, None, None, None))
    return pd.DataFrame(out, columns=["_at", "_day", "obs_date", "available_at", "value"])


def point_in_time(probes: DataFrame, observations: DataFrame, by: list[str], known_at: str, cutoff: str) -> DataFrame:
    """(by, known_at, cutoff, obs_date, available_at, value) of each distinct probe: of what was available at
    ``known_at`` and observed by ``cutoff``, the latest observation, and its latest vintage.

    An observation is never too old; one without a day, a time of availability or a
    value is none. Observations and probes of a key are united and sorted by time
    once, and a sweep answers each probe by bisection of the days observed so far,
    whatever the order in which revisions came; of vintages of one time the larger
    value counts. Probes with a null find nothing.
    """
    p = probes.select(*by, known_at, cutoff).distinct()
    sides = [
        observations.where("obs_date IS NOT NULL AND available_at IS NOT NULL AND value IS NOT NULL").select(*by, F.col("available_at").alias("_at"), F.col("obs_date").alias("_day"), F.col("value").cast("double").alias("_value"), F.lit(0).alias("_probe")),
        p.where(F.col(known_at).isNotNull() & F.col(cutoff).isNotNull()).select(*by, F.col(known_at).cast("timestamp").alias("_at"), F.col(cutoff).alias("_day"), F.lit(None).cast("double").alias("_value"), F.lit(1).alias("_probe")),
    ]
    keys = ", ".join(f"{c} {p.schema[c].dataType.simpleString()}" for c in by)

    def sweep(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _swept(rows).assign(**dict(zip(by, key, strict=True)))

    found = sides[0].unionByName(sides[1]).groupBy(*by).applyInPandas(sweep, f"{keys}, _at timestamp, _day date, obs_date date, available_at timestamp, value double")
    found = found.select(*by, F.col("_at").alias(known_at), F.col("_day").alias(cutoff), "obs_date", "available_at", "value")
    lost = p.where(F.col(known_at).isNull() | F.col(cutoff).isNull()).select(*by, known_at, cutoff, *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("obs_date", "available_at", "value")))
    return found.unionByName(lost)


def year_on_year(observations: DataFrame, by: list[str], known_at: Column) -> DataFrame:
    """Each month against the same month a year before, by the latest vintages known at ``known_at``."""
    known = observations.where(F.col("available_at") <= known_at).groupBy(*by, "obs_date").agg(F.max_by("value", "available_at").alias("value"))
    before = known.select(*by, F.add_months("obs_date", 12).alias("obs_date"), F.col("value").alias("before"))
    both = known.join(before, [*by, "obs_date"])
    return both.withColumn("yoy", F.col("value") / F.nullif(F.col("before"), F.lit(0.0)) - 1)


def forward_return(bars: DataFrame, horizons: tuple[int, ...] = (7, 14, 30)) -> DataFrame:
    """(symbol, day, horizon, target_day, target_return): from a close to the first close on or after so many calendar days; null at the end."""
    probes = bars.select("symbol", "day", "close", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    probes = probes.withColumn("due", F.date_add("day", F.col("horizon")))
    hits = forward(probes.select("symbol", F.col("due").alias("day")), bars.withColumnRenamed("close", "later"), ["symbol"], "day", "later")
    hits = hits.select("symbol", F.col("day").alias("due"), "later", F.col("seen").alias("target_day"))
    return probes.join(hits, ["symbol", "due"], "left").select("symbol", "day", "horizon", "target_day", (F.col("later") / F.col("close") - 1).alias("target_return"))
