"""The registered query of each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codec, divergence, host_reputation, merkle, mixing, near_text, near_vectors, packing, quality_model, quality_rules, shards, sql, storage, substring


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link_vectors(_read(spark, sf_dir, "embeddings"))


def op3_size_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    table = shards.arrive(spark, docs, storage.new_path(spark, "shards"), batch, 8)
    sizes = spark.createDataFrame([(s.name, s.bytes, table.tier(s)) for s in table.shards()], "name string, shard_bytes long, tier int")
    shard = F.col(table.shard_column)
    return table.read().select("doc_id", shard.alias("name")).join(sizes, "name").select("doc_id", F.col("name").alias("shard"), "shard_bytes", "tier", F.lit(table.version()).alias("version"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.remove_repeats(_read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels")
    good = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(F.expr("quality = 1 AND toxic = 0")).alias("good"))
    numbered = pages.select(F.col("page_id").alias("id"), host_reputation.page_number(F.col("url")).alias("doc_id"))
    outcomes = numbered.join(good, "doc_id").select("id", "good")
    return host_reputation.judge_urls(pages, outcomes, host_reputation.RULES)


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = bpe.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.link_documents(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_preimage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = merkle.leaf_digest(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))
    without = merkle.leaf_digest(*map(F.col, ("doc_id", "source", "lang", "n_chars")), F.replace("text", F.lit("\n"), F.lit("")))
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = _read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), leaf.alias("leaf"), F.when(tampered, without).otherwise(leaf).alias("found"))
    proven = merkle.prove(leaves).withColumn("folded_root", merkle.fold("found"))
    return proven.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_systolic_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = codec.encode(_read(spark, sf_dir, "documents"), *vocabulary)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    decoded = codec.decode(encoded.select("doc_id", "n_tokens", "ids", ids.alias("ids_sha256")), *vocabulary)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mixing": op1_pareto_mixing,
    "op2_pivot_index": op2_pivot_index,
    "op3_size_tiers": op3_size_tiers,
    "op4_quality_rules": op4_quality_rules,
    "op5_super_kmers": op5_super_kmers,
    "op6_host_reputation": op6_host_reputation,
    "op7_pu_quality": op7_pu_quality,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_bpe_counts": op9_bpe_counts,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_preimage_paths": op11_preimage_paths,
    "op12_systolic_audit": op12_systolic_audit,
    "op13_bpe_codec": op13_bpe_codec,
}

SQL: dict[str, str] = {
    "op1_pareto_mixing": sql.PARETO_MIXING,
    "op2_pivot_index": sql.PIVOT_INDEX,
    "op4_quality_rules": quality_rules.SQL,
    "op5_super_kmers": sql.SUPER_KMERS,
    "op6_host_reputation": host_reputation.SQL,
    "op10_ngram_jaccard": sql.NGRAM_JACCARD,
    "op11_preimage_paths": merkle.SQL,
    "op12_systolic_audit": divergence.SQL,
}
