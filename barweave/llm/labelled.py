"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import remainder


def spread(key: Column) -> Column:
    """Order in which a sample is drawn: fixed by the key, unrelated to it."""
    return F.xxhash64(key.cast("string"), F.lit("sample"))


def first_of_each(rows: DataFrame, key: str, target: str, each: int, most: int) -> DataFrame:
    """(key, target): at most ``each`` rows for a value of ``target`` and ``most`` in all, those first in hash order. Counts by
    value give the part of the hash range that holds about that many rows, so ranking sees no more than a little over ``each``
    rows of a value, however frequent it is. The counts that are broadcast are those of the ``most`` commonest values at most."""
    counts = rows.groupBy(target).agg(F.count(F.lit(1)).alias("of_value")).orderBy(F.desc("of_value"), target).limit(most)
    placed = rows.withColumn("place", F.pmod(spread(F.col(key)), F.lit(1 << 30))).join(F.broadcast(counts), target)
    near = placed.where(F.col("place") * F.col("of_value") <= (1 << 30) * (1.25 * each + 64))
    rank = F.row_number().over(Window.partitionBy(target).orderBy("place", key))
    return near.withColumn("rank", rank).where(F.col("rank") <= each).orderBy("rank", "place", key).limit(most).select(key, target)


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, folds: int, left_out: int, each: int,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, target) of a sample of at most ``each`` documents per label; labels of the fold ``left_out`` are never read.
    A document with several labels counts once, with the largest; only the sample's ids, a bounded number, are broadcast."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull() & (remainder(F.col(id_col), folds) != left_out))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(target).cast("int").alias("target"))
    chosen = first_of_each(usable, "id", "target", each, 2 * each)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "id")


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(remainder(F.col(id_col), folds) == fold, F.lit(False))
