"""The corpus operators applied to the driver's tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, importance, near_duplicates, quality_rules, substrings
from .common import table
from .decontaminate import find_contamination
from .html_text import extract_main_text
from .language import identify_languages
from .packing import pack_sequences
from .pii import find_personal_data
from .quality_model import score_quality
from .substrings import remove_repeated
from .token_counts import count_tokens
from .token_files import token_boundaries
from .tokens import vocabulary_path
from .whitening import whiten


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_boundaries(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents")).drop("runs")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op8_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language_id, op2_pii_spans, op3_token_files, op4_best_fit_packing, op5_jaccard_components, op6_repeated_substrings, op7_quality_rules,
        op8_quality_score, op9_main_text, op10_contamination, op11_importance_resampling, op12_whitened_embeddings, op13_token_counts, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_components": near_duplicates.ORACLE_SQL, "op6_repeated_substrings": substrings.ORACLE_SQL, "op7_quality_rules": quality_rules.ORACLE_SQL, "op10_contamination": decontaminate.ORACLE_SQL, "op11_importance_resampling": importance.ORACLE_SQL}
