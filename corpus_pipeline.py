"""Corpus cleaning pipeline over the documents table: each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barweave.llm.common import saved, table
from barweave.llm.stages import decontaminate, keep_quality, pack, remove_near_duplicates, sanitise

STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", sanitise),
    ("packing", pack),
]

#: The classifier, the tokenizer and the disclosure terms have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
