"""Article scoring, daily roll-up, join with bars, and decay over no-news days."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.calendar import utc_day
from barweave.functions.text import select_text, text_source

# Small polarity word lists of the built-in scorer.
POSITIVE_WORDS = ["gain", "gains", "good", "great", "growth", "improve", "profit", "rise", "strong", "up"]
NEGATIVE_WORDS = ["bad", "decline", "down", "drop", "fall", "loss", "poor", "risk", "weak", "worse"]

PROBS = ["positive_prob", "negative_prob", "neutral_prob"]
Scorer = Callable[[list[str]], "pd.DataFrame"]


def sentiment_cols(df: DataFrame) -> DataFrame:
    """Composite = positive - negative; scaled = (composite + 1) / 2."""
    composite = F.col("positive_prob") - F.col("negative_prob")
    return df.withColumns({"composite_score": composite, "scaled_sentiment": (composite + 1.0) / 2.0})


def with_text(articles: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Pick the text to score and drop articles that have none."""
    return articles.withColumns({
        "text_used": select_text(title, body), "text_source": text_source(title, body),
    }).where(F.col("text_source") != "empty")


def tokens_of(text) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t != "")


def score_by_words(df: DataFrame, text: str, positive: list[str], negative: list[str]) -> DataFrame:
    """Three-class softmax over word-list hit rates; one pass per row, no shuffle."""
    hits = lambda words: F.size(F.filter("_tokens", lambda t: t.isin(words)))
    scale = F.greatest(F.sqrt(F.col("n_tokens")), F.lit(1.0))
    logits = df.withColumn("_tokens", tokens_of(F.col(text))).withColumn("n_tokens", F.size("_tokens"))
    logits = logits.withColumns({"_p": hits(positive) / scale, "_n": hits(negative) / scale})
    total = F.exp("_p") + F.exp("_n") + 1.0
    return logits.withColumns({
        "positive_prob": F.exp("_p") / total, "negative_prob": F.exp("_n") / total, "neutral_prob": 1.0 / total,
    }).drop("_tokens", "_p", "_n")


def score_by_model(df: DataFrame, text: str, scorer: Scorer | None, batch: int, load: Callable[[], Scorer] | None = None) -> DataFrame:
    """A user scorer returning n_tokens and the three probabilities for a list of texts. Only the text column goes to Python.

    ``load`` makes the scorer inside the task, once for all its batches; a ready ``scorer`` travels with the plan instead.
    """
    fields = ["n_tokens", *PROBS]
    make = load or (lambda: scorer)

    @F.pandas_udf("n_tokens int, " + ", ".join(f"{p} double" for p in PROBS))
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = make()
        for texts in columns:
            parts = [score(texts.iloc[k:k + batch].tolist())[fields] for k in range(0, len(texts), batch)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=fields)

    return df.withColumn("_scored", run(F.col(text))).select(*df.columns, "_scored.*")


def score_articles(df: DataFrame, scorer: Scorer | None = None, batch: int = 256, text: str = "text_used",
                   positive: list[str] = POSITIVE_WORDS, negative: list[str] = NEGATIVE_WORDS,
                   load: Callable[[], Scorer] | None = None) -> DataFrame:
    """Score every text; with neither ``scorer`` nor ``load`` the word-list scorer runs entirely in the JVM."""
    scored = score_by_words(df, text, positive, negative) if scorer is None and load is None else \
        score_by_model(df, text, scorer, batch, load)
    return sentiment_cols(scored)


def daily_aggregates() -> list[Column]:
    return [
        F.avg("composite_score").alias("avg_composite"),
        F.avg("positive_prob").alias("avg_positive"),
        F.avg("negative_prob").alias("avg_negative"),
        F.avg("neutral_prob").alias("avg_neutral"),
        F.count("composite_score").alias("article_count"),
    ]


def daily_sentiment(scored: DataFrame, entity: str = "entity", ts: str = "ts") -> DataFrame:
    """Per entity and UTC day; partial aggregation keeps a busy entity off a single task."""
    return (
        scored.groupBy(entity, utc_day(ts).alias("date")).agg(*daily_aggregates())
        .withColumn("scaled_sentiment", (F.col("avg_composite") + 1.0) / 2.0)
    )


def first_per_day(daily: DataFrame, entity: str = "entity", date: str = "date", order: list | None = None) -> DataFrame:
    """One row per (entity, date): the first under ``order`` (all columns when not given)."""
    values = [c for c in daily.columns if c not in (entity, date)]
    ranked = F.struct(*[F.col(c) for c in (order or values)])
    picked = F.min_by(F.struct(*values), ranked).alias("_row")
    return daily.groupBy(entity, date).agg(picked).select(entity, date, "_row.*")


def merge_daily(bars: DataFrame, daily: DataFrame, entity: str = "entity", date: str = "date",
                order: list | None = None) -> DataFrame:
    """Left join on (entity, date); the bar count never changes; a missing count is 0."""
    joined = bars.join(first_per_day(daily, entity, date, order), [entity, date], "left")
    return joined.withColumn("article_count", F.coalesce("article_count", F.lit(0)))


def decay_impute(df: DataFrame, col: str, count: str = "article_count", half_life: float = 5.0,
                 neutral: float = 0.5, entity: str = "entity", date: str = "date", out: str | None = None) -> DataFrame:
    """Observed value on news days; else decay of the last one toward ``neutral`` by rows since."""
    news = F.col(count) > 0
    target = out or col
    if half_life <= 0:
        return df.withColumn(target, F.when(news, F.col(col)).otherwise(F.lit(neutral)))
    w = Window.partitionBy(entity).orderBy(date)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("_rn", F.row_number().over(w))
    seen = numbered.withColumns({
        "_last": F.last(F.when(news, F.col(col)), ignorenulls=True).over(past),
        "_at": F.last(F.when(news, F.col("_rn")), ignorenulls=True).over(past),
    })
    faded = neutral + (F.col("_last") - neutral) * F.exp(-math.log(2.0) / half_life * (F.col("_rn") - F.col("_at")))
    value = F.when(news, F.col(col)).otherwise(F.coalesce(faded, F.lit(neutral)))
    return seen.withColumn(target, value).drop("_rn", "_last", "_at")


def merged_bars(bars: DataFrame, daily: DataFrame, half_life: float = 5.0) -> DataFrame:
    """Join plus decay of both sentiment columns (0.5 and 0.0 are neutral)."""
    out = merge_daily(bars, daily)
    out = decay_impute(out, "scaled_sentiment", half_life=half_life, neutral=0.5)
    return decay_impute(out, "avg_composite", half_life=half_life, neutral=0.0)
