"""Registered queries of the corpus operators: name -> callable, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import sql
from barweave.llm.common import table
from barweave.llm.decontaminate import contamination
from barweave.llm.extract import main_text
from barweave.llm.language import languages
from barweave.llm.minhash import near_duplicates
from barweave.llm.negatives import EVERY as EVERY_ANCHOR
from barweave.llm.negatives import hard_negatives
from barweave.llm.packing import pack
from barweave.llm.pii import personal_data
from barweave.llm.quality import quality_scores
from barweave.llm.runs import periodic_runs
from barweave.llm.topk import EVERY, top_inner_products
from barweave.llm.toxicity import toxicity_scores
from barweave.llm.urls import document_labels, judged
from barweave.llm.warc import capture_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if text is not None:
            SQL[name] = text
        return run

    return register


#: Fixed rules of the contract: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op1_path_template_urls")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(pages, document_labels(pages, table(spark, sf_dir, "labels")), RULES)


@query("op2_norm_sorted_topk", sql.TOP_PRODUCTS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_inner_products(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_suffix_array_decontamination", sql.CONTAMINATION)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("matches")


@query("op5_multiple_instance_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("sentences")


@query("op6_warc_capture_index", sql.CAPTURES)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_subword_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


@query("op8_additive_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_disclosure_sanitisation")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@query("op10_circulant_minhash", sql.NEAR_DUPLICATES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold="0.85")


@query("op11_recurrent_extraction")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


@query("op12_bond_hard_negatives", sql.HARD_NEGATIVES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % EVERY_ANCHOR == 0)


def repeating(docs: DataFrame) -> DataFrame:
    """The contract's texts: where crc32 of the id ends in 0, the words from number a on become copies of the p words from a on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n, words = F.floor(h / 10), F.size("_words"), F.col("_words")
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, split).alias("_words"))
    rows = rows.withColumn("_a", F.when(n > 0, (g % n).cast("int")))
    rows = rows.withColumn("_p", F.when(n > 0, F.floor(1 + (n - F.col("_a")) / (3 + g % 8)).cast("int")))
    block = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    copies = F.flatten(F.array_repeat(block, F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("_a")), F.slice(copies, F.lit(1), n - F.col("_a"))), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeating(table(spark, sf_dir, "documents")), digest=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
