"""Equity-style inputs derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.operators.sentiment import sentiment_cols
from barweave.operators.signals import STRATEGIES, collect_signals
from barweave.operators.splits import yearly_folds
from barweave.operators.universe import CurationConfig

FOLDS = yearly_folds(1997, 3)
LENGTH = 52
HORIZONS = [1, 4]
CELL = ["strategy", "horizon", "fold"]
CURATION = CurationConfig(
    news_years=(1996, 1997), news_min=(70, 70), price_start=Date(1995, 1, 20), price_end=Date(2001, 10, 31),
    min_window_rows=200, liquidity_year=1997, min_liquidity_rows=40, max_gap_days=28, min_dollar_volume=1e6, target=300,
    coverage_years=list(range(1995, 2002)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """One bar per (supplier, week or day).

    Trades are ordered by (ship date, price, discount), packed into one integer so that first and last
    trade come out of the same hash aggregation as the other measures.
    """
    li = table(spark, sf_dir, "lineitem")
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    cents = lambda c: F.round(c * 100).cast("bigint")
    order = F.unix_date(F.to_date("l_shipdate")).cast("bigint") * 10**12 + cents(price) * 100 + cents(discount)
    day = F.to_date(F.date_trunc(grain, "l_shipdate"))
    per = li.groupBy(F.col("l_suppkey").alias("entity"), day.alias("date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume"),
        F.max_by(price * (1 - discount), order).alias("adj_close"))
    return per


ROW_ORDER = "row(l_shipdate, l_extendedprice, l_discount)"


def bars_sql(grain: str = "week") -> str:
    return f"""bars AS (
  SELECT l_suppkey AS entity, CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS date,
    arg_min(l_extendedprice, {ROW_ORDER}) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
    arg_max(l_extendedprice, {ROW_ORDER}) AS close, sum(l_quantity) AS volume,
    arg_max(l_extendedprice * (1 - l_discount), {ROW_ORDER}) AS adj_close
  FROM lineitem GROUP BY 1, 2)"""


BARS = bars_sql("week")
DAY_BARS = bars_sql("day")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_events(table(spark, sf_dir, "events"))


def score_events(ev: DataFrame) -> DataFrame:
    """Events (a table or a stream) as scored articles."""
    kind, v = F.col("event_type"), F.col("value")
    raw = lambda *names: 1.0 + F.when(kind.isin(*names), v).otherwise(0.0)
    scored = ev.select(
        F.col("event_id").alias("article_id"), F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("ts"),
        (raw("purchase", "signup") / (3.0 + v)).alias("positive_prob"), (raw("error") / (3.0 + v)).alias("negative_prob"),
        (raw("view", "click") / (3.0 + v)).alias("neutral_prob"), "event_type")
    return sentiment_cols(scored)


ARTICLES = """articles AS (
  SELECT *, positive_prob - negative_prob AS composite_score, (positive_prob - negative_prob + 1.0) / 2.0 AS scaled_sentiment
  FROM (SELECT event_id AS article_id, user_id AS entity, ts,
    (1.0::DOUBLE + CASE WHEN event_type IN ('purchase','signup') THEN value ELSE 0.0 END) / (3.0::DOUBLE + value) AS positive_prob,
    (1.0::DOUBLE + CASE WHEN event_type = 'error' THEN value ELSE 0.0 END) / (3.0::DOUBLE + value) AS negative_prob,
    (1.0::DOUBLE + CASE WHEN event_type IN ('view','click') THEN value ELSE 0.0 END) / (3.0::DOUBLE + value) AS neutral_prob,
    event_type FROM events) raw)"""


DAILY = """daily AS (
  SELECT entity, CAST(ts AS DATE) AS date, avg(composite_score) AS avg_composite, avg(positive_prob) AS avg_positive,
    avg(negative_prob) AS avg_negative, avg(neutral_prob) AS avg_neutral, count(composite_score) AS article_count,
    (avg(composite_score) + 1.0) / 2.0 AS scaled_sentiment
  FROM articles GROUP BY 1, 2)"""


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per entity and day from its first to its last event; a day without events keeps the last close, volume 0, and
    has no news."""
    ev = table(spark, sf_dir, "events")
    seen = ev.groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("date")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    spans = ev.groupBy(F.col("user_id").alias("entity")).agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))
    days = spans.select("entity", F.explode(F.sequence("first", "last")).alias("date"))
    held = Window.partitionBy("entity").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(seen, ["entity", "date"], "left").select(
        "entity", "date", F.last("close", ignorenulls=True).over(held).alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


EVENT_BARS = """event_bars AS (
  SELECT entity, date, last_value(close IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close,
    coalesce(volume, 0.0::DOUBLE) AS volume FROM (
    SELECT user_id AS entity, CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS DATE) AS date FROM events GROUP BY 1) d
  LEFT JOIN (SELECT user_id AS entity, CAST(ts AS DATE) AS date, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2) e
  USING (entity, date))"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as news: entity and timestamp."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").alias("ts"))


COUNTS = "counts AS (SELECT l_suppkey AS entity, year(l_shipdate) AS year, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy x horizon x fold on weekly bars (volume as the tilt column)."""
    return collect_signals(bars(spark, sf_dir), FOLDS, LENGTH, HORIZONS, STRATEGIES, "volume")


def test_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).where(F.col("split") == "test").drop("split")


def val_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).where(F.col("split") == "val").drop("split")


def date_literal(d: Date) -> str:
    return f"DATE '{d.isoformat()}'"


FOLD_ROWS = "folds AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{f.name}', {date_literal(f.train_end)}, {date_literal(f.val_start)}, {date_literal(f.val_end)}, "
    f"{date_literal(f.test_start)}, {date_literal(f.test_end)})" for f in FOLDS
) + ") v(fold, train_end, val_start, val_end, test_start, test_end))"

SPLIT_CASE = """CASE WHEN target_date <= train_end - e THEN 'train'
    WHEN date >= val_start + e AND target_date <= val_end - e THEN 'val'
    WHEN date >= test_start + e AND target_date <= test_end THEN 'test' END"""


def samples_sql(length: int = LENGTH, horizons: list[int] = HORIZONS) -> str:
    parts = " UNION ALL ".join(
        f"SELECT *, {h} AS horizon, CAST(ceil({h} * 7.0 / 5.0) AS INTEGER) AS e, tc{h} AS target_close, td{h} AS target_date FROM lagged"
        for h in horizons)
    leads = ", ".join(f"lead(close, {h}) OVER w AS tc{h}, lead(date, {h}) OVER w AS td{h}" for h in horizons)
    back = lambda k: f"lag(close, {min(k, length) - 1}) OVER w"
    return f"""lagged AS (
  SELECT *, row_number() OVER w AS rn, {back(21)} AS c_near, {back(252)} AS c_far, {back(5)} AS c_short, {back(60)} AS c_mid,
    lag(close, 1) OVER w AS c_prev, {leads} FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)),
samp AS (SELECT *, rn - 1 AS anchor_idx, rn - {length} AS start_idx, ln(target_close / close) AS y_logret
  FROM ({parts}) u WHERE rn >= {length} AND close > 1e-6 AND target_close > 1e-6),
labelled AS (SELECT * FROM (SELECT samp.*, folds.fold, {SPLIT_CASE} AS split FROM samp, folds) z WHERE split IS NOT NULL)"""


SAMPLES = samples_sql()
SCALER = """scaler AS (
  SELECT entity, fold, avg(close) AS mu_close, CASE WHEN stddev_pop(close) < 1e-9 THEN 1.0 ELSE stddev_pop(close) END AS sd_close,
    avg(volume) AS mu_volume, CASE WHEN stddev_pop(volume) < 1e-9 THEN 1.0 ELSE stddev_pop(volume) END AS sd_volume
  FROM bars JOIN folds ON bars.date <= folds.train_end GROUP BY 1, 2)"""
SIGNALS = """base AS (
  SELECT l.*, sd_close, (volume - mu_volume) / sd_volume AS z_volume FROM labelled l JOIN scaler USING (entity, fold) WHERE split <> 'train'),
signals AS (
  SELECT 'xs_momentum' AS strategy, horizon, fold, split, date, entity, (c_near - c_far) / sd_close AS pred, y_logret AS actual FROM base
  UNION ALL SELECT 'xs_reversal', horizon, fold, split, date, entity, -(close - c_short) / sd_close, y_logret FROM base
  UNION ALL SELECT 'ridge_alpha', horizon, fold, split, date, entity,
    (c_near - c_far) / sd_close - 0.3 * (close - c_prev) / sd_close + 0.5 * (close - c_mid) / sd_close + 0.2 * z_volume, y_logret FROM base)"""
SIGNAL_CTES = [BARS, FOLD_ROWS, SAMPLES, SCALER, SIGNALS]
PANEL = "panel AS MATERIALIZED (SELECT strategy, horizon, fold, date, entity, pred, actual FROM signals WHERE split = 'test')"
VAL = "panel AS MATERIALIZED (SELECT strategy, horizon, fold, date, entity, pred, actual FROM signals WHERE split = 'val')"
PANEL_CTES = [*SIGNAL_CTES, PANEL]
VAL_CTES = [*SIGNAL_CTES, VAL]
