"""The corpus pipeline: rules, near duplicates, repeated passages, mixing, packing.

Each stage takes the documents that the stage before has kept, as a Parquet table,
and all but the last return the columns of ``documents``; further columns are
dropped. A document is a row: rows without an id and rows that share one are
judged each by itself, under a key that is made for them, and go only by a
stage's own decision. Null texts, languages and sources are handled as the
operators say; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import mixing, near_text, packing, quality_rules, substring
from tideline.llm.storage import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with a ``key`` of their own: the id if every row has one for itself.

    Else the rows are sorted by id (null last) and content, dealt to tasks by
    both, and numbered, so keys keep the order of ids; the table is written, as
    numbers of rows must not change from one reading to the next.
    """
    docs = docs.select(*COLUMNS)
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        return docs.withColumn("key", F.col("doc_id"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(*COLUMNS[1:]), "text", "lang", "source", "n_chars")
    return written(ordered.withColumn("key", F.monotonically_increasing_id()), "keyed")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoff of their language, or of a pool where it has too few labels."""
    rows = keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(rows.select("doc_id", "key"), "doc_id").drop("doc_id")
    judged = quality_rules.judge(rows, labels, id_col="key")
    return rows.join(judged.where("kept").select("key"), "key", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates."""
    rows = keyed(docs)
    linked = near_text.link_documents(rows, id_col="key")
    firsts = linked.where("n_shingles = 0 OR component_id = key").select("key")
    return rows.join(firsts, "key", "left_semi").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier; a document left without words goes, one that loses none keeps its layout."""
    rows = keyed(docs)
    kept = substring.remove_repeats(rows, id_col="key", layout=True).where("n_words > n_removed").select("key", F.col("text").alias("kept"))
    texts = rows.drop("text", "n_chars").join(kept, "key")
    return texts.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows = keyed(docs)
    taken = mixing.mix(rows, id_col="key").where("copies > 0").select("key", "copies")
    return rows.join(taken, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and the place in it of every piece of every copy."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("super_kmers", passages),
    ("pareto_mixing", mixture),
    ("best_fit_packing", bins),
]

#: SQL cannot express the packing, whose bins depend on the order in which documents meet them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
