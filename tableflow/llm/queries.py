"""One registered query per operator, over its whole tables, with DuckDB SQL
where SQL expresses it.  The queries derive the digest columns that callers
compare from what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.llm import decontaminate, jaccard, licenses, lines, lm, merkle, mixing, packing, quality_rules, repair, sharding, suffixes, toxicity
from tableflow.llm.common import table, tokenizer_file
from tableflow.llm.oracles import ORACLES


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("matches")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.suffix_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("failed_rules")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.line_dedup(table(spark, sf_dir, "documents"), "all", lines.LONG_WORDS, min_bytes=lines.LONG_BYTES, passage_words=lines.PASSAGE_WORDS)
    return cleaned.select("doc_id", "n_removed", "removed_bytes", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.in_training_part())
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (~toxicity.in_training_part()).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").cast("bigint").alias("n_offending"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False).drop("ids")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"), merkle.damaged())


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damaged(table(spark, sf_dir, "conversations")), F.col("alive"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_suffix_dedup, op3_quality_rules, op4_lm_scoring, op5_substring_dedup, op6_toxicity, op7_decontamination, op8_jaccard_join, op9_packing, op10_sharding, op11_merkle_manifest, op12_source_mixing, op13_conversation_repair)}

__all__ = ["ORACLES", "QUERIES"]
