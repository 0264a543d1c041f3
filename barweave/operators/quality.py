"""Audits of scored articles, daily rows, merged bars, coverage and calendars."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.maths import safe_corr
from barweave.operators.ordering import running_index
from barweave.operators.sentiment import PROBS


def failures(**tests: Column) -> Column:
    """Names of the tests that hold, as an array."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))


def near(low: float, high: float) -> Column:
    a, b, c = (F.col(p).between(low, high) for p in PROBS)
    return (a & b & c).cast("double")


def audit_articles(scored: DataFrame, entity: str = "entity") -> DataFrame:
    """Degenerate spread or more than 5 % near-uniform rows per entity."""
    per = scored.groupBy(entity).agg(
        F.count("positive_prob").alias("n"), F.stddev_samp("positive_prob").alias("sd_positive"),
        F.avg(near(0.32, 0.34)).alias("uniform_share"))
    return per.withColumn("failures", failures(
        empty=F.col("n") == 0, flat=F.col("sd_positive") < 1e-3, uniform=F.col("uniform_share") > 0.05))


def block_aggregates() -> list[Column]:
    third = [(F.abs(F.col(p) - 1.0 / 3.0) < 0.01) for p in PROBS]
    return [
        F.count(F.lit(1)).alias("n"),
        F.max(F.abs(sum((F.col(p) for p in PROBS[1:]), F.col(PROBS[0])) - 1.0)).alias("max_sum_error"),
        F.stddev_pop("positive_prob").alias("sd_positive"),
        F.avg((third[0] & third[1] & third[2]).cast("double")).alias("uniform_share"),
    ]


def block_failures(df: DataFrame) -> DataFrame:
    return df.withColumn("failures", failures(
        sum=F.col("max_sum_error") > 1e-3, flat=F.col("sd_positive") < 1e-3, uniform=F.col("uniform_share") > 0.05))


def audit_blocks(scored: DataFrame, block: int = 4096, entity: str = "entity", ts: str = "ts",
                 tie: str = "article_id") -> DataFrame:
    """Audit consecutive blocks of ``block`` rows per entity.

    Rows are numbered through hour slots, so one entity's articles never meet in one task.
    """
    placed = running_index(scored, [entity], [ts, tie], F.date_trunc("hour", F.col(ts)))
    blocks = placed.groupBy(entity, F.floor(F.col("idx") / block).alias("block")).agg(*block_aggregates())
    return block_failures(blocks)


def audit_daily(daily: DataFrame, entity: str = "entity", date: str = "date") -> DataFrame:
    total = F.col("avg_positive") + F.col("avg_negative") + F.col("avg_neutral")
    per = daily.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_days"), F.stddev_samp("scaled_sentiment").alias("sd_scaled"),
        F.max(F.abs(total - 1.0)).alias("max_sum_error"),
        (F.count(F.lit(1)) - F.count_distinct(date)).alias("duplicates"))
    return per.withColumn("failures", failures(
        flat=F.col("sd_scaled") < 0.02, sum=F.col("max_sum_error") > 1e-3, duplicate=F.col("duplicates") > 0))


def audit_merged(bars: DataFrame, merged: DataFrame, entity: str = "entity") -> DataFrame:
    before = bars.groupBy(entity).agg(F.count(F.lit(1)).alias("n_bars"))
    after = merged.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_merged"), F.stddev_samp("scaled_sentiment").alias("sd_scaled"))
    both = before.join(after, entity, "full_outer")
    return both.withColumn("failures", failures(
        row_count=~F.col("n_bars").eqNullSafe(F.col("n_merged")), flat=F.col("sd_scaled") < 0.02))


def time_trend_corr(df: DataFrame, col: str, entity: str = "entity", date: str = "date") -> DataFrame:
    """Correlation of the row position with ``col`` per entity, over rows where it is known."""
    w = Window.partitionBy(entity).orderBy(date)
    rows = df.where(F.col(col).isNotNull()).withColumn("_i", F.row_number().over(w).cast("double"))
    return rows.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(col).alias("sd"), safe_corr("_i", col).alias("time_corr"))


def audit_entity(merged: DataFrame, col: str = "scaled_sentiment", min_rows: int = 100, entity: str = "entity") -> DataFrame:
    per = time_trend_corr(merged, col, entity).where(F.col("n") >= min_rows)
    status = (
        F.when((F.col("sd") < 0.02) | (F.abs("time_corr") > 0.6), "FAIL").when(F.col("sd") < 0.05, "WARN").otherwise("OK"))
    return per.withColumn("status", status)


def audit_cache(scaled: DataFrame, n: int | None = None, col: str = "scaled_sentiment", entity: str = "entity") -> DataFrame:
    """Population spread of the cached column; ``n`` limits the check to the first entities by name."""
    if n is not None:
        first = scaled.select(entity).distinct().orderBy(entity).limit(n)
        scaled = scaled.join(first, entity, "left_semi")
    per = scaled.groupBy(entity).agg(F.stddev_pop(col).alias("sd"))
    return per.withColumn("failed", F.col("sd") < 1e-3)


def check_coverage(coverage: DataFrame, years: list[int], folds: list, min_year: int = 30, min_fold: int = 20) -> DataFrame:
    """Entities short of articles: per required year and per fold validation/test year."""
    checks = [(f"year_{y}", f"n_{y}", min_year) for y in years]
    checks += [(f"{f.name}_{part}", f"n_{y}", min_fold) for f in folds
               for part, y in (("val", f.val_year), ("test", f.test_year))]
    rows = F.array(*[F.struct(F.lit(k).alias("check"), (F.col(c) < m).alias("bad")) for k, c, m in checks])
    return coverage.select(F.explode(rows).alias("_c")).groupBy(F.col("_c.check").alias("check")).agg(
        F.count_if("_c.bad").alias("n_bad")).withColumn("passed", F.col("n_bad") == 0)


def check_calendar(folds: DataFrame) -> DataFrame:
    """Each fold: train before validation before test, one-day gap between validation and test."""
    return folds.select(
        "fold",
        (F.col("train_end") < F.col("val_start")).alias("train_before_val"),
        (F.col("val_end") < F.col("test_start")).alias("val_before_test"),
        (F.date_diff("val_start", "train_end") == 1).alias("train_gap_one_day"),
        (F.date_diff("test_start", "val_end") == 1).alias("val_gap_one_day"),
    ).withColumn("passed", F.col("train_before_val") & F.col("val_before_test")
                 & F.col("train_gap_one_day") & F.col("val_gap_one_day"))


def check_price_range(universe: DataFrame, bars: DataFrame, first_by: Date = Date(2009, 1, 15),
                      last_from: Date = Date(2023, 12, 15), entity: str = "entity", date: str = "date") -> DataFrame:
    span = bars.groupBy(entity).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    status = (
        F.when(F.col("first_date").isNull(), "missing").when(F.col("first_date") > F.lit(first_by), "starts_late")
        .when(F.col("last_date") < F.lit(last_from), "ends_early").otherwise("ok"))
    return universe.select(entity).distinct().join(span, entity, "left").withColumn("status", status)


def cross_entity_variance(scored: DataFrame, entity: str = "entity", min_sd: float = 0.02) -> DataFrame:
    means = scored.groupBy(entity).agg(F.avg("composite_score").alias("m"))
    return means.agg(F.count("m").alias("n_entities"), F.stddev_pop("m").alias("sd_means")).withColumn(
        "passed", (F.col("n_entities") >= 3) & (F.col("sd_means") >= min_sd))


def labelled_sanity(scored: DataFrame, label: str = "label", need: float = 0.75, above: float = 0.5) -> DataFrame:
    """Share of labelled rows whose own class gets a probability above ``above`` (3 of 4 must)."""
    own = F.when(F.col(label) == "positive", F.col("positive_prob")).when(
        F.col(label) == "negative", F.col("negative_prob")).otherwise(F.col("neutral_prob"))
    return scored.where(F.col(label).isNotNull()).agg(
        F.count(F.lit(1)).alias("n_labelled"), F.count_if(own > above).alias("n_right")).withColumn(
        "passed", F.coalesce(F.try_divide(F.col("n_right"), F.col("n_labelled")) >= need, F.lit(False)))
