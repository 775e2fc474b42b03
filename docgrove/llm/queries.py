"""The thin queries opN_<name> of this subpackage, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, conversations, decontamination, hard_negatives, jaccard, lm_scoring, mixing, quality, secrets, sharding, substrings, token_counts, training_order
from .shared import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op1_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.proximity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op2_query(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op4_query(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op5_query(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op6_query(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op7_query(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.op8_query(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op9_query(table(spark, sf_dir, "documents"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.op10_query(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op11_query(table(spark, sf_dir, "embeddings"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.op12_query(table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.op13_query(table(spark, sf_dir, "documents"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_quality that the method's verdict does not enter."""
    found = quality.base_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op4_secrets."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6_sharding promises of its shards: rows, and gapless slots from 0."""
    found = op6_sharding(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("slot").alias("n_slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    return found.select(F.col("shard").cast("bigint").alias("shard"), "n_rows", "n_slots", "first_slot", "last_slot")


def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of op7_token_counts: the lines of every text, which tile it."""
    return op7_token_counts(spark, sf_dir).select("doc_id", "section", "char_start", "char_end")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op1_proximity": op1_proximity,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_jaccard": op5_jaccard,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_substrings": op9_substrings,
    "op10_training_order": op10_training_order,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversations": op12_conversations,
    "op13_packing": op13_packing,
    "quality_base_counts": quality_base_counts,
    "secret_counts": secret_counts,
    "shard_sizes": shard_sizes,
    "section_spans": section_spans,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op5_jaccard": jaccard.ORACLE,
    "op9_substrings": substrings.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "quality_base_counts": quality.BASE_ORACLE,
    "secret_counts": secrets.COUNTS_ORACLE,
    "shard_sizes": sharding.SIZES_ORACLE,
    "section_spans": token_counts.SPANS_ORACLE,
}
