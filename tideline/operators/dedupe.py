"""Headlines: exact and near duplicates, counts by keyword cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, word_set
from ..sources.tables import saved


def by_prefix(rows: DataFrame, order: list[str], n: int = 60) -> DataFrame:
    """The first row, in ``order``, of each lower-cased title prefix."""
    w = Window.partitionBy(F.lower(F.substring("title", 1, n))).orderBy(*order)
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def jaccard_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of different titles whose word sets are at least so similar.

    Equal word sets count once, by their smallest id. A set's rarest words are
    its prefix: similar sets share one, so only rows with a common prefix word
    are compared. Sets travel with their prefix words, and a pair is judged where
    it meets, at its first common word: no table of candidates is shuffled, so what
    travels grows with the rows.
    """
    t = rows.select("id", F.array_sort(word_set(F.col("title"))).alias("words")).where("size(words) > 0")
    t = saved(t.groupBy("words").agg(F.min("id").alias("id")).withColumn("row", F.monotonically_increasing_id()))
    each = t.select("row", "id", F.explode("words").alias("w"))
    df = each.groupBy("w").agg(F.count("*").alias("df"))
    ranked = each.join(df, "w").groupBy("row", "id").agg(F.sort_array(F.collect_list(F.struct("df", "w")))["w"].alias("words"))
    ranked = saved(ranked.withColumn("n", F.size("words")))
    up = lambda c: F.ceil(c - 1e-9).cast("int")
    heads = ranked.select("id", "n", "words", F.posexplode(F.slice("words", F.lit(1), F.col("n") - up(F.col("n") * least) + 1)).alias("k", "w"))
    a, b = heads.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("k").alias("ka"), F.col("words").alias("x"), "w"), heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb"), F.col("words").alias("y"), "w")
    # so many common words are needed; none comes before the first one, so the sets' rests bound them
    need = up((F.col("na") + F.col("nb")) * (least / (1 + least)))
    near = (F.col("a") < F.col("b")) & (F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb")) >= need)
    common = F.array_intersect("x", "y")
    met = a.join(b, "w").where(near & (F.size(common) >= need) & (F.get(common, F.lit(0)) == F.col("w")))
    return met.select("a", "b", jaccard(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= least)


def keep_first(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that stay when one is dropped if it is similar to a smaller id that stays.

    The order decides who stays, so it is settled in rounds: an id stays once all
    its smaller neighbours have gone, and goes once one of them stays. In every
    round the smallest open id of each group of links is settled, so the rounds
    end, at the latest with the longest chain of ids that wait for each other.
    """
    links = pairs.select(F.col("a").alias("small"), F.col("b").alias("id"))
    state = ids.select("id", F.lit(None).cast("boolean").alias("stays"))
    while True:
        before = links.join(state.select(F.col("id").alias("small"), F.col("stays").alias("s")), "small").groupBy("id").agg(F.max(F.coalesce("s", F.lit(False)).cast("int")).alias("kept"), F.max(F.col("s").isNull().cast("int")).alias("open"))
        new = F.coalesce("stays", F.when(F.coalesce("kept", F.lit(0)) == 1, False).when(F.coalesce("open", F.lit(0)) == 0, True))
        state = saved(state.join(before, "id", "left").select("id", new.alias("stays")))
        if not state.where("stays IS NULL").limit(1).count():
            return state.where("stays").select("id")
