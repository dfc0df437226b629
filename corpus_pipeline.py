"""A training corpus from ``documents``: five stages, each on what the one before kept.

Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import kept, table
from loomwork.llm.decontaminate import drop_contaminated
from loomwork.llm.near_duplicates import keep_one
from loomwork.llm.packing import pack_sequences
from loomwork.llm.pii import redact_personal_data
from loomwork.llm.quality_rules import keep_good
from loomwork.llm.tokens import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = redact_personal_data(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 1024."""
    return pack_sequences(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the tokenizer or the spans of the PII stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, drop = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, own = kept(stage(spark, docs, sf_dir), name)
        if drop:
            drop()  # the stage is written: what it read is used up
        drop = own
    return STAGES[-1][1](spark, docs, sf_dir)
