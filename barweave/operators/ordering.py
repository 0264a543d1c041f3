"""Ranks, quantiles and running positions that never put a whole group in one task.

One group may hold a large share of all rows (a date with every entity, a
source with a third of the articles). Ranks and quantiles come from one range
exchange: rows are dealt by (group, value) into ranges of equal size, so a
large group spans several ranges, each range counts on its own, and what
precedes a range in its first group is added from one row per range. Positions
along time work on time slots of the group. Edges affect balance only, never
the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.session import cut_lineage

RANKED = ["n_less", "n_eq", "n_total", "bucket"]
_LOCAL = ["_less", "_eq", "_n", "_part", "_first_tie", "_last_tie", "_first_group", "_last_group", "_edge"]


def changes(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """Whether each row differs from the one before in any column; nulls and NaN equal themselves."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(n, bool)
    out[:1] = True
    for column in columns:
        column = column.combine_chunks()
        now, was = column.slice(1), column.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(now, was), False), pc.and_(pc.is_null(now, nan_is_null=True), pc.is_null(was, nan_is_null=True)))
        out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


def spans(starts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For stretches that begin where ``starts`` holds: their number per row, their weight per row, and the first row of each."""
    first = np.flatnonzero(starts)
    number = np.cumsum(starts) - 1
    return number, np.add.reduceat(weight, first)[number], first


def range_ranks(df: DataFrame, keys: list[str], col: str, weight: str | None = None, ties: list[str] = [], parts: int = 0) -> DataFrame:
    """``df`` with, per group of ``keys``: n_less and n_eq (weight of smaller and of equal values of ``col``), n_total and the
    range's number ``bucket``. NULL values take no part. One range exchange sorts by (keys, col, ties); ``ties`` names columns that
    tell equal values apart, so that a value shared by many rows is spread as well.

    The sorted ranges are checkpointed, since their edges come from a sample and must be the same for both readers: the first and
    last row of every range (two rows a range) give the offsets, one row a range, that are joined by the range's number. A range
    is held as Arrow columns by its task; ``parts``, at least ``spark.sql.shuffle.partitions``, sets their number."""
    spark = df.sparkSession
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = df.where(F.col(col).isNotNull()).withColumn("_rank_w", (F.lit(1) if weight is None else F.col(weight)).cast("bigint"))
    ordered = known.repartitionByRange(parts, *keys, col, *ties).sortWithinPartitions(*keys, col, *ties).withColumn("_part", F.spark_partition_id())
    kinds = [T.LongType()] * 3 + [T.IntegerType()] + [T.BooleanType()] * 5
    schema = T.StructType([f for f in ordered.schema if f.name not in ("_rank_w", "_part")] + [T.StructField(n, t) for n, t in zip(_LOCAL, kinds)])
    names = schema.names

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        w, n = rows["_rank_w"].to_numpy(), rows.num_rows
        new_group = changes([rows[k] for k in keys]) if keys else np.arange(n) == 0
        new_tie = new_group | changes([rows[col]])
        group, total, group_at = spans(new_group, w)
        tie, equal, tie_at = spans(new_tie, w)
        before = np.cumsum(w) - w
        less = before[tie_at][tie] - before[group_at][group]
        edge = np.zeros(n, bool)
        edge[[0, -1]] = True
        made = [less, equal, total, rows["_part"].to_numpy(), tie == 0, tie == tie[-1], group == 0, group == group[-1], edge]
        out = rows.drop_columns(["_rank_w", "_part"])
        for name, values in zip(_LOCAL, made):
            out = out.append_column(name, pa.array(values))
        yield from out.to_batches(max_chunksize=10000)

    local = cut_lineage(ordered.mapInArrow(count, schema))
    ends = local.where("_edge").select(*keys, col, *_LOCAL).collect()  # two rows a range at most
    shifts = spark.createDataFrame(offsets([r.asDict() for r in ends], keys, col) or [(-1, 0, 0, 0, 0, 0)],
                                   "_part int, _base bigint, _tie_before bigint, _tie_after bigint, _group_before bigint, _group_after bigint")
    shifted = local.join(F.broadcast(shifts), "_part")
    only = lambda flag, c: F.when(F.col(flag), F.col(c)).otherwise(F.lit(0))
    return shifted.withColumns({
        "n_less": F.col("_less") + only("_first_group", "_base") - only("_first_tie", "_tie_before"),
        "n_eq": F.col("_eq") + only("_first_tie", "_tie_before") + only("_last_tie", "_tie_after"),
        "n_total": F.col("_n") + only("_first_group", "_group_before") + only("_last_group", "_group_after"),
        "bucket": F.col("_part")}).select(*[c for c in names if c not in _LOCAL], *RANKED)


def offsets(ends: list[dict[str, Any]], keys: list[str], col: str) -> list[tuple[int, ...]]:
    """(range, weight of its first group and tie in earlier ranges, of its last tie and group in later ranges) from the end rows."""
    value = lambda v: "NaN" if v != v else v
    by_part: dict[int, list[dict[str, Any]]] = {}
    for r in ends:
        by_part.setdefault(r["_part"], []).append(r)
    order = sorted(by_part)
    first = [next(r for r in by_part[p] if r["_first_tie"]) for p in order]
    last = [next(r for r in by_part[p] if r["_last_tie"]) for p in order]

    def carried(names: list[str], weight: str, here: list[dict], there: list[dict], steps: range) -> list[int]:
        """Weight that the stretch at one end of each range has in the ranges before it along ``steps``."""
        of = lambda r: tuple(value(r[n]) for n in names)
        out, open_at, total = [0] * len(order), None, 0
        for i in steps:
            out[i] = total if open_at == of(here[i]) else 0
            total = there[i][weight] + (out[i] if of(here[i]) == of(there[i]) else 0)
            open_at = of(there[i])
        return out

    up, down = range(len(order)), range(len(order) - 1, -1, -1)
    group_before, tie_before = carried(keys, "_n", first, last, up), carried([*keys, col], "_eq", first, last, up)
    group_after, tie_after = carried(keys, "_n", last, first, down), carried([*keys, col], "_eq", last, first, down)
    return list(zip(order, group_before, tie_before, tie_after, group_before, group_after))


def value_ranks(df: DataFrame, keys: list[str], col: str, weight: Column | None = None, splits: int = 0) -> DataFrame:
    """Per group, the distinct values with counts: ``value, n_eq, n_less, n_total, bucket``.

    Ties collapse in the first (partially aggregated) count, so a value shared by most rows costs one row; ``splits`` is the
    least number of ranges.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("value")).agg(
        F.sum(F.lit(1) if weight is None else weight).cast("long").alias("_count"))
    return range_ranks(counts, keys, "value", "_count", parts=splits).select(*keys, "value", "n_eq", "n_less", "n_total", "bucket")


def exact_quantiles(df: DataFrame, keys: list[str], col: str, probs: dict[str, float],
                    interpolate: bool = True, splits: int = 0) -> DataFrame:
    """Exact quantiles per group, one output column per entry of ``probs``; ``splits`` as in ``value_ranks``.

    ``interpolate`` gives the linear rule; otherwise the lower order statistic.
    """
    ranked = value_ranks(df, keys, col, splits=splits)
    aggs = []
    for name, p in probs.items():
        at = (F.col("n_total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)

        def holds(k):
            return (F.col("n_less") <= k) & (k < F.col("n_less") + F.col("n_eq"))

        aggs += [F.max(F.when(holds(low), F.col("value"))).alias(f"_lo_{name}"),
                 F.max(F.when(holds(high), F.col("value"))).alias(f"_hi_{name}"),
                 F.max(at - low).alias(f"_w_{name}")]
    out = ranked.groupBy(*keys).agg(*aggs, F.max("n_total").alias("n"))
    lo = lambda n: F.col(f"_lo_{n}").cast("double")
    return out.select(*(keys or []), "n", *[
        (lo(n) + (F.col(f"_hi_{n}") - lo(n)) * F.col(f"_w_{n}") if interpolate else lo(n)).alias(n)
        for n in probs
    ])


def running_index(df: DataFrame, keys: list[str], order: list, slot: Column, name: str = "idx") -> DataFrame:
    """0-based position of each row within its group under ``order``.

    ``slot`` must be non-decreasing along the order (for example the hour of
    the timestamp); rows are numbered inside (group, slot) and shifted by the
    count of earlier slots.
    """
    slotted = df.withColumn("_slot", slot)
    by_slot = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    shifts = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_slot", (F.sum("_n").over(by_slot) - F.col("_n")).alias("_shift"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order)
    return (
        slotted.withColumn("_in", F.row_number().over(inside) - 1)
        .join(shifts, [*keys, "_slot"])
        .withColumn(name, F.col("_shift") + F.col("_in"))
        .drop("_slot", "_in", "_shift")
    )


def last_before(df: DataFrame, keys: list[str], order: str, slot: Column, flag: Column,
                name: str) -> DataFrame:
    """Largest ``order`` value at or before each row (in its group) whose ``flag`` holds."""
    marked = df.withColumn("_slot", slot).withColumn("_mark", F.when(flag, F.col(order)))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(*keys, "_slot").agg(F.max("_mark").alias("_m")).select(
        *keys, "_slot", F.max("_m").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("_local", F.max("_mark").over(inside))
        .join(carried, [*keys, "_slot"])
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_slot", "_mark", "_local", "_carry")
    )
