"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir), works on all of ``docs`` and, but for the last, returns
the columns it was given. Other tables are read from ``sf_dir``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import packing, pii, quality
from barweave.llm.common import table
from barweave.llm.decontaminate import without_leaks
from barweave.llm.minhash import without_near_duplicates

#: The general rule for near duplicates on five-word shingles.
SIMILARITY = "0.8"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one with the smallest id; of repeated rows one stays. Documents without words
    or without an id are no one's copies and stay."""
    return without_near_duplicates(docs, threshold=SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of the benchmark occurs."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and terms that disclose it; n_chars follows the new text."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences; one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
