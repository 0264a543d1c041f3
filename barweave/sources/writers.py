"""Sinks, manifests and the scaled cache."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators.quality import failures
from barweave.operators.splits import apply_minmax, fit_minmax


def write_by_entity(df: DataFrame, path: str, entity: str = "entity", date: str = "date", buckets: int | None = None,
                    time_slices: int = 1) -> None:
    """Parquet sorted by (entity, date).

    One folder per entity by default, which suits a curated universe of some hundreds. For many
    entities give ``buckets``: entities share hash-bucket folders. ``time_slices`` spreads one
    entity's rows over several sorted files (years round-robin), so a dominant entity has no single writer.
    """
    slice_ = F.pmod(F.year(date), F.lit(time_slices))
    if buckets is None:
        laid = df.repartition(F.col(entity), slice_).sortWithinPartitions(entity, date)
        laid.write.mode("overwrite").partitionBy(entity).parquet(path)
        return
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(entity), F.lit(buckets)))
    laid = bucketed.repartition(F.col("bucket"), slice_).sortWithinPartitions("bucket", entity, date)
    laid.write.mode("overwrite").partitionBy("bucket").parquet(path)


def manifest(df: DataFrame, value: str, entity: str = "entity", date: str = "date", min_sd: float = 0.02) -> DataFrame:
    """One row per entity: rows, first and last date, mean, deviation, failures and status."""
    per = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("sd_value"))
    per = per.withColumn("failures", failures(empty=F.col("mean_value").isNull(), flat=F.col("sd_value") < min_sd))
    return per.withColumn("status", F.when(F.size("failures") == 0, "ok").otherwise("failed"))


def minmax_cache(bars: DataFrame, cols: list[str], val_start: Date, test_start: Date, entity: str = "entity",
                 date: str = "date") -> DataFrame:
    """Min-max scaled rows tagged with the split dates they were built for."""
    scaled = apply_minmax(bars, fit_minmax(bars, cols, None, entity, date), cols, entity)
    return scaled.select(entity, date, *[f"mm_{c}" for c in cols]).withColumns({
        "built_val_start": F.lit(val_start), "built_test_start": F.lit(test_start)})


def stale_entities(cache: DataFrame, val_start: Date, test_start: Date, entity: str = "entity") -> DataFrame:
    """Cached entities built for other split dates."""
    stale = (F.col("built_val_start") != F.lit(val_start)) | (F.col("built_test_start") != F.lit(test_start))
    return cache.where(stale).select(entity).distinct()


def write_cache(bars: DataFrame, path: str, cols: list[str], val_start: Date, test_start: Date, entity: str = "entity",
                date: str = "date") -> DataFrame:
    """Scale, store and read back; every row carries the split dates it was built for."""
    minmax_cache(bars, cols, val_start, test_start, entity, date).write.parquet(path)
    return bars.sparkSession.read.parquet(path)


def refresh_cache(bars: DataFrame, cache: DataFrame, path: str, cols: list[str], val_start: Date, test_start: Date,
                  entity: str = "entity", date: str = "date") -> DataFrame:
    """Next version of a stored cache below ``path``: entities built for other dates, or missing, are scaled anew, entities
    without bars are left out, all others are copied. ``rebuilt`` tells which."""
    due = bars.select(entity).distinct()
    good = cache.select(entity).distinct().join(stale_entities(cache, val_start, test_start, entity), entity, "left_anti")
    kept = cache.drop("rebuilt").join(due.join(good, entity, "left_semi"), entity, "left_semi").withColumn("rebuilt", F.lit(False))
    again = minmax_cache(bars.join(due.join(good, entity, "left_anti"), entity, "left_semi"), cols, val_start, test_start, entity, date)
    kept.unionByName(again.withColumn("rebuilt", F.lit(True))).write.parquet(path)
    return bars.sparkSession.read.parquet(path)


def write_summaries(summaries: DataFrame, path: str) -> None:
    summaries.write.mode("overwrite").json(path)
