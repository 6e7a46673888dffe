"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Within it, a document's expected copies depend
on its size class; the whole part are certain copies, and for one more copy the
fraction is its inclusion probability. Documents are ranked by the odds of a
random number over the odds of that probability (Pareto sampling), and the first
ones are taken until the source's remaining words are reached: a sample of fixed
size, in words, with unequal probabilities.

A source may hold most rows, so nothing is ranked over a whole source. Ranks are
cut into bins, words are summed by bin, and rows are compared only within the one
bin in which the sum is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: No source and no document is taken more than CAP times; a document of double size is 2^-DAMPING as likely.
CAP, DAMPING, BINS, SEED = 3, 0.125, 1 << 16, 17
WORD = r"[^\x20\x09-\x0D]+"
#: Two Pareto ranks closer than this are ties, which ids decide.
STEP = 1 << 40


def capped_shares(groups: DataFrame, by: list[str], order: str, total: Column, weight: Column, cap: Column, name: str) -> DataFrame:
    """Split ``total`` over rows by ``weight``, none above its ``cap``; the excess goes to the others by weight.

    In the order of cap over weight, a row is capped if its cap is below its part
    of what the rows before it leave. Once one is not, none is.
    """
    g = groups.withColumns({"_t": total, "_w": weight, "_c": cap}).withColumn("_r", F.col("_c") / F.col("_w"))
    w = Window.partitionBy(*by).orderBy("_r", order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumns({"_used": F.coalesce(F.sum("_c").over(before), F.lit(0.0)), "_gone": F.coalesce(F.sum("_w").over(before), F.lit(0.0)), "_all": F.sum("_w").over(Window.partitionBy(*by))})
    g = g.withColumn("_level", (F.col("_t") - F.col("_used")) / (F.col("_all") - F.col("_gone")))
    g = g.withColumn("_level", F.when(F.col("_r") > F.col("_level"), F.col("_level")))
    level = F.first("_level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    g = g.withColumn("_level", level).withColumn(name, F.when(F.col("_level").isNull() | (F.col("_r") <= F.col("_level")), F.col("_c")).otherwise(F.col("_w") * F.col("_level")))
    return g.drop("_t", "_w", "_c", "_r", "_used", "_gone", "_all", "_level")


def uniform(id_: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the id and the seed only."""
    hexes = F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(hexes, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): weights 1, 2, 3, repeating, by the sources' code points, null last."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source"))
    sources = sources.withColumn("weight", ((rank - 1) % 3 + 1).cast("double")).withColumn("all", F.lit(0))
    total = F.sum("source_size").over(Window.partitionBy("all")).cast("double")
    return capped_shares(sources, ["all"], "source", total, F.col("weight"), (F.col("source_size") * CAP).cast("double"), "target").drop("all", "weight")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every row; ``taken`` is copies times size.

    Size is the number of words, 0 for null and empty texts, which are never
    taken. Null sources are one source. Rows with equal ids have equal random
    numbers; ties are decided by id and size, and among rows equal in all of
    these one is as good as the other, so reruns agree. A null id counts as an
    id. Other columns are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    sizes = written(sizes, "sizes").withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size")) - 1).otherwise(-1))
    by_source = written(targets(sizes), "targets")

    # copies that are expected of each size class: a source's target over its classes, capped likewise
    classes = sizes.groupBy("source", "class").agg(F.sum("size").alias("words")).where("words > 0")
    classes = classes.join(by_source, classes["source"].eqNullSafe(by_source["source"])).drop(by_source["source"])
    words = F.col("words").cast("double")
    classes = capped_shares(classes, ["source"], "class", F.col("target"), words * F.pow(F.lit(2.0), -DAMPING * F.col("class")), words * CAP, "part")
    expected = F.round(F.col("part") / F.col("words"), 9)
    classes = classes.select("source", "class", "words", F.floor(expected).alias("whole"), (expected - F.floor(expected)).alias("odd"), "target")
    left = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    classes = written(classes.withColumn("left", left), "classes")

    # at most about 40 size classes of each source: a small table, joined by both
    table = classes.select("source", "class", "whole", "odd", "left")
    ranked = sizes.join(table, sizes["source"].eqNullSafe(table["source"]) & (sizes["class"] == table["class"]), "left").select(sizes["id"], sizes["source"], "size", "whole", "odd", "left")
    u = uniform(F.col("id"), seed)
    odds = (u / (1 - u)) / (F.col("odd") / (1 - F.col("odd")))
    ranked = ranked.withColumn("rank", F.when(F.col("odd") > 0, F.floor(odds / (1 + odds) * STEP).cast("long")))
    ranked = written(ranked.withColumn("bin", F.floor(F.col("rank") / (STEP // BINS)).cast("int")), "ranked")

    # the bin in which the source's words are reached
    w = Window.partitionBy("source").orderBy("bin")
    bins = ranked.where("bin IS NOT NULL").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    bins = bins.withColumn("upto", F.sum("words").over(w))
    last = bins.where("upto > left AND upto - words <= left").select("source", F.col("bin").alias("last"), (F.col("upto") - F.col("words")).alias("before"))
    last = written(last, "last")
    joined = ranked.join(last, ranked["source"].eqNullSafe(last["source"]), "left").drop(last["source"])
    inside = joined.where("bin = last")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("extra", (upto <= F.col("left")).cast("int"))
    outside = joined.where("bin IS NULL OR last IS NULL OR bin != last").withColumn("extra", F.when(F.col("bin").isNull(), 0).when(F.col("last").isNull() | (F.col("bin") < F.col("last")), 1).otherwise(0))
    chosen = written(outside.unionByName(inside).drop("last", "before"), "chosen")

    # one document more, that of the size nearest to what is still missing
    got = chosen.groupBy("source").agg(F.first("left", ignorenulls=True).alias("left"), F.sum(F.col("extra") * F.col("size")).alias("got"))
    missing = got.select("source", (F.col("left") - F.col("got")).alias("missing"))
    free = chosen.where("extra = 0 AND size > 0 AND whole < %d" % CAP).groupBy("source", "size").agg(F.min(F.struct("rank", "id")).alias("first"))
    free = free.join(missing, free["source"].eqNullSafe(missing["source"])).drop(missing["source"])
    gap = F.abs(F.col("missing") - F.col("size"))
    best = free.where(gap < F.col("missing")).groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "size", "first")).alias("best"))
    best = written(best.select("source", F.col("best.size").alias("size"), F.col("best.first.id").alias("id"), F.lit(1).alias("fill")), "fill")
    first = F.row_number().over(Window.partitionBy("source", "id", "size").orderBy("extra"))
    fill = chosen.join(best, chosen["source"].eqNullSafe(best["source"]) & chosen["id"].eqNullSafe(best["id"]) & (chosen["size"] == best["size"]) & (chosen["extra"] == 0), "left_semi")
    fill = fill.withColumn("n", first).withColumn("extra", F.when(F.col("n") == 1, 1).otherwise(F.col("extra"))).drop("n")
    rest = chosen.join(best, chosen["source"].eqNullSafe(best["source"]) & chosen["id"].eqNullSafe(best["id"]) & (chosen["size"] == best["size"]) & (chosen["extra"] == 0), "left_anti")
    final = rest.unionByName(fill)
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.col("extra")
    out = final.join(by_source, final["source"].eqNullSafe(by_source["source"]), "left").drop(by_source["source"])
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
