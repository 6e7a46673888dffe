"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def _smallest(links: DataFrame, name: str) -> DataFrame:
    return written(links.groupBy("u").agg(F.min("v").alias("m")).where("m < u"), name)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) for each id with a link to a smaller or larger one.

    ``component_id`` is the smallest id reachable. Alternating large-star and
    small-star steps (Kiveris et al., 2014) replace links by links to the
    smallest neighbour until nothing changes; each step is an aggregate and a
    join over written tables, so a hub with very many links is pre-aggregated
    and its rows can be split over tasks. Links with a null end and links of an
    id to itself are ignored; repeated links count once.
    """
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(now, "links")
    state = None
    while True:
        # large star: what is above u comes to link to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = _smallest(both, "lowest")
        up = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        up = up.join(lowest, "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
        now = written(up, "large-star")
        # small star: u and what is below it come to link to the smallest below u
        lowest = _smallest(now, "lowest")
        down = now.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(lowest.select("u", F.col("m").alias("v")).union(down).distinct(), "small-star")
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == state:
            break
    # every id now has one link, to the smallest of its component
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots.select("id", F.col("id").alias("component_id")))
