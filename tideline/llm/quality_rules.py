"""Quality rules whose cutoffs are certified on labelled holdouts.

Each document gets a few rule scores (higher is worse). All rules are tightened
together along one path: at the cutoff t a document is rejected whose share of
symbols is over the cube of t, or whose repeats or repeated lines are over t. Its risk is the
tightest cutoff that still keeps it, so a cutoff is one number, and what it loses
of the clean documents only grows as it tightens. Of a stratum with enough labels,
all cutoffs are certified at which an exact binomial test rejects "more than
``alpha`` of the clean documents would be lost"; testing from the loosest on needs
no correction within a stratum, and the error level ``delta`` is split over the
strata that have enough labels and one pool (Bonferroni). How many that are depends
on the numbers of labels alone. Among certified cutoffs the one is taken that
parts labelled junk from clean documents best, the loosest of equal ones.

Strata with too few labels take the cutoff of a pool: of all such strata together,
or, if these have too few labels as well, of all strata. A pool's loss is bounded
over all of its strata together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

SPACE = r"[\x20\x09-\x0D]+"
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
RULES = ("noise", "repeats", "dup_lines")
#: Cutoffs are GRID-ths of 1. Largest share of a stratum's clean documents that may be lost, and the chance of being wrong.
GRID, ALPHA, DELTA = 50, 0.02, 0.05
WINDOW = 8


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """Counts and rule scores of every whole text; null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    rows = rows.select(
        "id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _count(F.col("text"), "!").cast("long").alias("n_exclaims"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.when(F.size("words") >= WINDOW, F.expr(f"transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))")).alias("codes"),
    )
    rows = rows.withColumns({"n_lines": F.size("lines"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}).drop("lines")
    # most texts repeat no window; only the others are sorted
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("codes")) < F.size("codes"), F.expr("sort_array(transform(codes, (c, i) -> struct(c AS c, i AS i)))"))).drop("codes")
    rows = rows.withColumn("starts", F.expr("sort_array(transform(filter(sorted, (x, k) -> x.c = get(sorted, k - 1).c OR x.c = get(sorted, k + 1).c), x -> x.i))")).drop("sorted")
    covered = F.expr(f"aggregate(transform(starts, (x, k) -> least({WINDOW}, coalesce(get(starts, k + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)")
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("starts")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return rows.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
            "noise": share(F.col("n_symbols") + F.col("n_exclaims"), F.col("word_chars")),
            "repeats": share(F.col("n_repeat_words"), F.col("n_words")),
            "dup_lines": share(F.col("n_dup_lines"), F.col("n_lines")),
        }
    )


def most_losses(n: Column, alpha: float, level: Column) -> Column:
    """The largest k for which P(Binomial(n, alpha) <= k) <= level; -1 if there is none.

    The terms are summed from k = 0 in logarithms, up to the mean, where the sum
    passes any level below a half.
    """
    odds = f"ln({alpha!r}D / (1 - {alpha!r}D))"
    return F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.floor(n * F.lit(alpha))),
        F.struct((n * F.log(F.lit(1 - alpha))).alias("log"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k")),
        lambda s, i: F.struct(
            (s["log"] + F.expr(odds) + F.log((n - i).cast("double") / (i + 1))).alias("log"),
            (s["sum"] + F.exp(s["log"])).alias("sum"),
            F.when(s["sum"] + F.exp(s["log"]) <= level, i).otherwise(s["k"]).alias("k"),
        ),
        lambda s: s["k"],
    )


def risk() -> Column:
    """The tightest cutoff that keeps a document: no rule's score is over its place on the path."""
    return F.greatest(F.round(F.cbrt("noise"), 9), "repeats", "dup_lines")


def fewest_labels(alpha: float, level: float) -> float:
    """Clean labels that certify a cutoff if none of them is lost."""
    return math.log(level) / math.log(1 - alpha)


def certify(measured: DataFrame, labels: DataFrame, label_id: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(pooled, stratum, cutoff) of every stratum that can be certified, and of the pool of the others (its stratum is null).

    Clean documents are those whose labels are all 1, junk is what else has labels;
    what already fails the base rules is no loss of the method.
    """
    judged = labels.where(F.col("quality").isNotNull()).groupBy(F.col(label_id).alias("id")).agg((F.min("quality") == 1).alias("clean"))
    step = F.least(F.lit(GRID + 1), F.ceil(risk() * GRID)).cast("int")
    held = measured.where("NOT base_failed").join(judged, "id").groupBy("stratum", step.alias("step")).agg(F.count_if("clean").alias("clean"), F.count_if(~F.col("clean")).alias("junk"))
    held = written(held, "held")
    counts = held.groupBy(F.col("stratum").alias("s")).agg(F.sum("clean").alias("n"))
    level = delta / (counts.where(F.col("n") >= fewest_labels(alpha, delta)).count() + 1)
    few = counts.where(F.col("n") < fewest_labels(alpha, level))
    rest = few.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    one_of_few = F.col("stratum").eqNullSafe(F.col("s"))
    pool = held if rest < fewest_labels(alpha, level) else held.join(few, one_of_few, "left_semi")
    groups = held.join(few, one_of_few, "left_anti").withColumn("pooled", F.lit(False)).unionByName(pool.withColumns({"pooled": F.lit(True), "stratum": F.lit(None).cast("string")}))
    steps = groups.groupBy("pooled", "stratum", "step").agg(F.sum("clean").alias("clean"), F.sum("junk").alias("junk"))
    tables = steps.groupBy("pooled", "stratum").agg(F.sum("clean").alias("n"), F.sum("junk").alias("all_junk"), F.map_from_entries(F.collect_list(F.struct("step", F.struct("clean", "junk")))).alias("at"))
    tables = tables.withColumn("most", most_losses(F.col("n"), alpha, F.lit(level))).where("most >= 0")
    # a cutoff of step j/GRID loses what lies above it
    above = lambda c: f"aggregate(sequence(j + 1, {GRID + 1}), 0L, (a, t) -> a + coalesce(at[t].{c}, 0L))"
    lost = F.expr(f"transform(sequence(1, {GRID}), j -> struct({above('clean')} AS lost, {above('junk')} AS caught, j AS j))")
    best = F.expr("array_max(transform(filter(cuts, c -> c.lost <= most), c -> struct(c.caught * n - c.lost * greatest(all_junk, 1L) AS parted, c.j AS j))).j")
    return tables.withColumn("cuts", lost).select("pooled", "stratum", (best / GRID).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, scores, ``base_failed`` and ``kept`` of every row, under id_col.

    Null and empty texts have no words and fail the base rules. A null stratum is
    a stratum of its own. Rows with null or repeated ids keep their rows; labels
    that are null are not used, and an id with labels of both kinds is not clean.
    At the defaults and four strata a stratum needs 228 clean labels that pass the
    base rules for a cutoff of its own; with fewer it takes the pool's, and with too
    few labels in all only the base rules hold. The cutoffs that are gathered on
    the driver are at most the labels' number over that, and one.
    """
    measured = written(measure(docs, id_col, text_col, stratum_col), "measured")
    cutoffs = certify(measured, labels, id_col, alpha, delta).collect()
    own = {r.stratum: r.cutoff for r in cutoffs if not r.pooled}
    known = [F.lit(x) for s, c in own.items() if s is not None for x in (s, c)]
    cutoff = F.create_map(*known)[F.col("stratum")] if known else F.lit(None).cast("double")
    if None in own:
        cutoff = F.when(F.col("stratum").isNull(), own[None]).otherwise(cutoff)
    cutoff = F.coalesce(cutoff, *(F.lit(r.cutoff) for r in cutoffs if r.pooled))
    over = F.coalesce(risk() > cutoff, F.lit(False))
    return measured.withColumn("kept", ~F.col("base_failed") & ~over).withColumnRenamed("id", id_col)


SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
n AS (SELECT doc_id, lang, words, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(text) - length(replace(text, '!', '')) AS n_exclaims,
        len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM w),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM n WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS covered FROM rep GROUP BY doc_id),
m AS (SELECT n.doc_id, lang, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, coalesce(covered, 0)::BIGINT AS n_repeat_words,
        CASE WHEN word_chars > 0 THEN (n_symbols + n_exclaims)::DOUBLE / word_chars ELSE 0 END AS noise,
        CASE WHEN n_words > 0 THEN coalesce(covered, 0)::DOUBLE / n_words ELSE 0 END AS repeats,
        CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_lines
        FROM n LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
risks AS (SELECT *, greatest(round(cbrt(noise), 9), repeats, dup_lines) AS risk FROM b),
held AS (SELECT lang, clean, least({GRID + 1}, ceil(risk * {GRID}))::INT AS step FROM risks
        JOIN (SELECT doc_id, min(quality) = 1 AS clean FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
counts AS (SELECT lang, count(*) FILTER (WHERE clean) AS n FROM held GROUP BY lang),
lev AS (SELECT {DELTA!r}::DOUBLE / ((SELECT count(*) FROM counts WHERE n >= {fewest_labels(ALPHA, DELTA)!r}) + 1) AS level),
few AS (SELECT lang, n FROM counts, lev WHERE n < ln(level) / ln(1 - {ALPHA!r}::DOUBLE)),
groups AS (SELECT FALSE AS pooled, lang, clean, step FROM held h WHERE NOT EXISTS (SELECT 1 FROM few WHERE few.lang IS NOT DISTINCT FROM h.lang)
  UNION ALL SELECT TRUE, NULL, clean, step FROM held h, lev WHERE (SELECT coalesce(sum(n), 0) FROM few) < ln(level) / ln(1 - {ALPHA!r}::DOUBLE) OR EXISTS (SELECT 1 FROM few WHERE few.lang IS NOT DISTINCT FROM h.lang)),
tot AS (SELECT pooled, lang, count(*) FILTER (WHERE clean) AS n, count(*) FILTER (WHERE NOT clean) AS junk FROM groups GROUP BY 1, 2),
terms AS (SELECT pooled, lang, n, k, n * ln(1 - {ALPHA!r}::DOUBLE) + k * ln({ALPHA!r}::DOUBLE / (1 - {ALPHA!r}::DOUBLE))
          + coalesce(sum(CASE WHEN k > 0 THEN ln((n - k + 1)::DOUBLE / k) END) OVER (PARTITION BY pooled, lang ORDER BY k), 0) AS log
          FROM (SELECT pooled, lang, n, unnest(generate_series(0, floor(n * {ALPHA!r}::DOUBLE)::BIGINT)) AS k FROM tot)),
cdf AS (SELECT pooled, lang, k, sum(exp(log)) OVER (PARTITION BY pooled, lang ORDER BY k) AS p FROM terms),
most AS (SELECT pooled, lang, max(k) AS most FROM cdf, lev WHERE p <= level GROUP BY 1, 2),
cuts AS (SELECT g.pooled, g.lang, j, count(*) FILTER (WHERE clean AND step > j) AS lost, count(*) FILTER (WHERE NOT clean AND step > j) AS caught FROM groups g, generate_series(1, {GRID}) AS s(j) GROUP BY 1, 2, 3),
cut AS (SELECT c.pooled, c.lang, arg_max(j, (caught * n - lost * greatest(junk, 1), j)) / {GRID}.0::DOUBLE AS cutoff FROM cuts c JOIN tot t ON t.pooled = c.pooled AND t.lang IS NOT DISTINCT FROM c.lang
  JOIN most m ON m.pooled = c.pooled AND m.lang IS NOT DISTINCT FROM c.lang WHERE lost <= most GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(risk > coalesce((SELECT cutoff FROM cut WHERE NOT pooled AND cut.lang IS NOT DISTINCT FROM r.lang), (SELECT cutoff FROM cut WHERE pooled)), FALSE) AS kept
FROM risks r
"""
