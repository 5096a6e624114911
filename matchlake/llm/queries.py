"""Registered queries of the corpus operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, archives, conversations, decontaminate, html_blocks, licences, mixing, neardup, outliers, pii, rules, suffix_tree, topk


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of each document."""
    return rules.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data in each document."""
    return pii.personal_data(_table(spark, folder, "documents"))


def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licences named or quoted in each document."""
    return licences.licences(_table(spark, folder, "documents"))


def op4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Five best candidates of every 50th vector by whole-number inner product."""
    return topk.nearest(_table(spark, folder, "embeddings"))


def op5_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of each document by token counts and by the suffix tree."""
    return suffix_tree.score(_table(spark, folder, "documents"))


def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of each page."""
    return html_blocks.extracted(_table(spark, folder, "pages"))


def op7_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the pages' archives after conversion."""
    return archives.archived(_table(spark, folder, "pages"))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Component of each document over 4-word shingles at similarity 0.8."""
    return neardup.near_duplicates(_table(spark, folder, "documents"), shingle=4, percent=80)


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document inside 10-word windows of the benchmark."""
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return decontaminate.summary(found)


def op10_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of each document under raked token weights, and whether it is kept."""
    return mixing.mixture(_table(spark, folder, "documents"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in each document."""
    return alignment.aligned(_table(spark, folder, "documents"))


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of each damaged conversation and its cheapest repair."""
    table = _table(spark, folder, "conversations")
    return conversations.audited(table, conversations.damaged(table))


def op13_quality_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Base quality rules and robust outliers within each language and source."""
    return outliers.outliers(_table(spark, folder, "documents")).drop("distance")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_personal_data": op2_personal_data,
    "op3_licences": op3_licences,
    "op4_nearest": op4_nearest,
    "op5_language_model": op5_language_model,
    "op6_main_text": op6_main_text,
    "op7_archives": op7_archives,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_decontamination": op9_decontamination,
    "op10_mixture": op10_mixture,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversations": op12_conversations,
    "op13_quality_outliers": op13_quality_outliers,
}

#: SQL that gives the same rows; queries without one are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_nearest": topk.SQL,
    "op7_archives": archives.SQL,
    "op10_mixture": mixing.sql(),
    "op12_conversations": conversations.SQL,
    "op13_quality_outliers": outliers.sql(),
}
