"""The corpus pipeline: stages that each apply one corpus operator to what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm.base import stored, table
from skyledger.llm.decontamination import drop_contaminated
from skyledger.llm.language_id import keep_identified
from skyledger.llm.near_dedup import keep_first
from skyledger.llm.packing import pack
from skyledger.llm.secret_scan import redact


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (2): documents without a language go."""
    return keep_identified(spark, docs, sf_dir)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup (5) on five-word shingles: one document of each group stays."""
    return keep_first(spark, docs, sf_dir)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination (9): documents that hold a benchmark item go."""
    return drop_contaminated(spark, docs, sf_dir)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans (1): spans give way to a mask, all documents stay."""
    return redact(spark, docs, sf_dir)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (3): the pieces of all documents with their sequences."""
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]
#: SQL can't express profiles, signatures or the packing plan; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
