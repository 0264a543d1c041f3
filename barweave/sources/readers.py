"""Scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.functions.text import norm_symbol
from barweave.operators.evaluate import COST_METRICS
from barweave.sources.csv_files import read_by_header

# Column names of the raw files and their names here.
NEWS_COLUMNS = {"Date": "ts", "Stock_symbol": "entity", "Article_title": "title", "Article": "body",
                "Url": "url", "Publisher": "publisher"}
PRICE_COLUMNS = ["date", "open", "high", "low", "close", "adj close", "volume"]

SUMMARY_SCHEMA = (
    "model string, horizon int, fold string, arm string, best_top_n int, n_test_timestamps long, inference_valid boolean, "
    "ci_tier string, ic_mean double, ic_std double, "
    "cost_sensitivity map<string, struct<" + ", ".join(f"{m}: double" for m in COST_METRICS) + ">>, "
    "longonly_appendix map<string, struct<" + ", ".join(f"{m}: double" for m in COST_METRICS) + ">>, "
    "sweep_topn array<struct<top_n: int, val_sharpe_gross: double, val_n_obs: long>>"
)


def to_utc(text: Column) -> Column:
    """Timestamp text with or without zone; unreadable text becomes NULL."""
    cleaned = F.regexp_replace(F.trim(text), r"\s*UTC$", "Z")
    return F.try_to_timestamp(cleaned)


def read_news(spark: SparkSession, path: str, trimmed: bool = True) -> DataFrame:
    """News CSV with quoted multi-line bodies, columns by each file's header; rows with an unreadable date or no symbol are dropped.
    A single large file is read by many tasks."""
    return news_rows(read_by_header(spark, path, NEWS_COLUMNS, ("Url", "Publisher", "Article_title"), multi_line=True).drop("_file"), trimmed)


def news_rows(raw: DataFrame, trimmed: bool = True) -> DataFrame:
    return raw.withColumn("ts", to_utc(F.col("ts"))).withColumn("entity", norm_symbol("entity", trimmed)).dropna(subset=["ts", "entity"])


def stage_news(spark: SparkSession, path: str, out: str, parts: int) -> DataFrame:
    """Read news files once and store them as ``parts`` splittable Parquet parts; gives the stored table."""
    read_news(spark, path).repartition(parts).write.parquet(out)
    return spark.read.parquet(out)


def read_prices(spark: SparkSession, path: str, stem: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """Per-entity price files as one table, columns by each file's own header; the entity is the upper-cased file stem.

    ``stem`` extracts it from the path, e.g. ``entity=([^/]+)/`` for folder layouts.
    """
    raw = read_by_header(spark, path, {c: c.replace(" ", "_") for c in PRICE_COLUMNS}, ("adj close",))
    rows = raw.withColumn("entity", F.upper(F.regexp_extract("_file", stem, 1))).drop("_file")
    numbers = {c.replace(" ", "_"): F.col(c.replace(" ", "_")).try_cast("double") for c in PRICE_COLUMNS if c != "date"}
    return rows.withColumns(numbers).withColumn("date", F.to_date(to_utc(F.col("date")))).dropna(subset=["date"])


def load_summaries(spark: SparkSession, path: str, fold: str | None = None, one_per_file: bool = True) -> DataFrame:
    """Cell summary documents, one per file or one per line (nested map and array kept typed)."""
    docs = spark.read.schema(SUMMARY_SCHEMA).option("multiLine", one_per_file).option("allowNonNumericNumbers", True).json(path)
    return docs if fold is None else docs.where(F.col("fold") == fold)


def unpivot_panel(df: DataFrame, date: str = "date") -> DataFrame:
    """Wide ``pred_<id>`` / ``actual_<id>`` columns to (date, entity, pred, actual), ids on both sides only.

    The pairing happens on column names, so the data needs a single map-side expansion.
    """
    pred, actual = ({c[len(p):] for c in df.columns if c.startswith(p)} for p in ("pred_", "actual_"))
    common = sorted(pred & actual)
    if not common:
        raise ValueError("no matching pred_/actual_ column pairs")
    rows = F.array(*[F.struct(F.lit(k).alias("entity"), F.col(f"pred_{k}").cast("double").alias("pred"),
                              F.col(f"actual_{k}").cast("double").alias("actual")) for k in common])
    return df.select(date, F.explode(rows).alias("_p")).select(date, "_p.*")
