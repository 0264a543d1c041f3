"""Stationary block bootstrap, reproducible under any partitioning.

A cell's series, one value per date, travels once as a list. A replicate is a sequence of blocks: starts are uniform, lengths
geometric, both read from one hash of (seed, cell, replicate, block), so a lost task redraws the same numbers. Sums over a block
are differences of prefix sums, so a replicate costs one step a block and not one a row. Replicates are dealt over tasks in chunks
of a cell: neither the number of cells nor the longest one limits how many tasks share the work.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barweave.functions.maths import TINY, let
from barweave.operators.metrics import periods

N_HARD, N_WARN, N_REPLICATES = 6, 12, 100
QUIET_RUN = 5
CHUNK = 100


def indexed(ts: DataFrame, keys: list[str], cols: list[str], order: str = "row_idx") -> DataFrame:
    """Rows where every column is known, with their 0-based position ``i`` and the count ``n`` per cell."""
    known = ts.dropna(subset=cols)
    own = Window.partitionBy(*keys)
    return known.withColumns({
        "i": (F.row_number().over(own.orderBy(order)) - 1).cast("long"), "n": F.count(F.lit(1)).over(own)})


def pair_arms(a: DataFrame, b: DataFrame, keys: list[str], col: str = "net", order: str = "row_idx") -> DataFrame:
    """Pair two arms' known values by position and cut to the shorter one."""
    left = indexed(a, keys, [col], order).select(*keys, "i", F.col(col).alias("a"))
    right = indexed(b, keys, [col], order).select(*keys, "i", F.col(col).alias("b"))
    both = left.join(right, [*keys, "i"])
    return both.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def pair_columns(ts: DataFrame, keys: list[str], arm: str, first: str, second: str, col: str = "net", order: str = "row_idx") -> DataFrame:
    """``pair_arms`` of two values of the column ``arm`` of one frame, which is read once."""
    rows = indexed(ts.where(F.col(arm).isin(first, second)), [*keys, arm], [col], order)
    side = lambda v: F.max(F.when(F.col(arm) == v, F.col(col)))
    both = rows.groupBy(*keys, "i").agg(side(first).alias("a"), side(second).alias("b")).dropna(subset=["a", "b"])
    return both.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


# ---- one row per cell ------------------------------------------------------------------

def series_of(rows: DataFrame, keys: list[str], values: list[str], carry: dict[str, Column] = {}, order: str = "i") -> DataFrame:
    """keys, n, one list a value column (``v_``), in order, and what ``carry`` aggregates."""
    entry = F.struct(F.col(order).alias("_at"), *[F.col(v).cast("double").alias(v) for v in values])
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_s"), *[c.alias(n) for n, c in carry.items()])
    return lists.select(*keys, F.size("_s").cast("long").alias("n"), *[F.col(f"_s.{v}").alias(f"v_{v}") for v in values], *carry)


def cell_name(keys: list[str]) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


def cube_root_block(n: int) -> float:
    """max(2, n^(1/3)); 2 below four rows."""
    return 2.0 if n < 4 else max(2.0, n ** (1.0 / 3.0))


def plug_in_block(x: np.ndarray) -> float:
    """Politis-White plug-in: lags up to twice the start of the first run of insignificant autocovariances, under a flat-top
    window; the cube-root rule where the result is below 2 or the long-run variance vanishes."""
    n = len(x)
    if n < 4:
        return cube_root_block(n)
    dev = x - x.mean()
    top = min(math.ceil(math.sqrt(n)) + QUIET_RUN, n - 1)
    acov = np.array([dev[k:] @ dev[:n - k] for k in range(top + 1)]) / n
    quiet = np.abs(acov[1:]) < 2.0 * math.sqrt(math.log10(n) / n) * acov[0]
    calm = np.flatnonzero(np.convolve(quiet, np.ones(QUIET_RUN, int), "valid") == QUIET_RUN) if top >= QUIET_RUN else np.zeros(0, int)
    m = min(2 * (int(calm[0]) + 1), top) if len(calm) else top
    lag = np.arange(1, m + 1)
    flat_top = np.minimum(1.0, 2.0 * (1.0 - lag / m))
    long_run = acov[0] + 2.0 * (flat_top @ acov[1:m + 1])
    slope = 2.0 * (flat_top @ (lag * acov[1:m + 1]))
    if abs(long_run) <= TINY:
        return cube_root_block(n)
    best = min(((slope / long_run) ** 2 * n) ** (1.0 / 3.0), math.ceil(min(3.0 * math.sqrt(n), n / 3.0)))
    return float(best) if best >= 2.0 else cube_root_block(n)


def with_cell_block(lists: DataFrame, values: list[str], block: float | str | None) -> DataFrame:
    """``lists`` with the expected block length: the cube-root rule (None), a number, or "auto", the mean of the plug-in lengths of
    the value columns."""
    if block != "auto":
        root = F.when(F.col("n") < 4, 2.0).otherwise(F.greatest(F.lit(2.0), F.pow(F.col("n").cast("double"), 1.0 / 3.0)))
        return lists.withColumn("block", root if block is None else F.lit(max(2.0, float(block))))
    schema = T.StructType([*lists.schema.fields, T.StructField("block", T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[plug_in_block(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(f"v_{v}")] for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.mean(found, axis=0), pa.float64())], names=names)

    return lists.mapInArrow(run, schema)


def block_length(ts: DataFrame, keys: list[str], col: str = "net", order: str = "row_idx", automatic: bool = False) -> DataFrame:
    """Expected block length per cell: the cube-root rule or the Politis-White plug-in."""
    lists = series_of(indexed(ts, keys, [col], order), keys, [col])
    return with_cell_block(lists, [col], "auto" if automatic else None).select(*keys, "n", "block")


def with_block(rows: DataFrame, block: float | str | None, keys: list[str] | None = None, values: list[str] | None = None) -> DataFrame:
    """Rows with the block length of their cell; see ``with_cell_block``."""
    if block != "auto":
        return with_cell_block(rows, [], block)
    of_cell = with_cell_block(series_of(rows, keys, values), values, block).select(*keys, "block")
    return rows.join(of_cell, keys)


# ---- replicates ------------------------------------------------------------------------

def block_draws(seed: int, cell: str, rep: int, n: int, block: float) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of one replicate's blocks; lengths add up to n."""
    starts, lengths, left, j = [], [], n, 0
    shrink = math.log(1.0 - 1.0 / block)
    while left > 0:
        digest = hashlib.md5(f"{seed}|{cell}|{rep}|{j}".encode()).hexdigest()
        size = min(left, 1 + math.floor(math.log(1.0 - int(digest[:8], 16) / 4294967296.0) / shrink))
        starts.append(int(int(digest[8:16], 16) / 4294967296.0 * n))
        lengths.append(size)
        left, j = left - size, j + 1
    return np.array(starts), np.array(lengths)


class Circle:
    """A series closed to a circle: sums over arcs, and whether an arc is constant."""

    def __init__(self, x: np.ndarray):
        self.x, self.mean = x, x.mean()
        dev = np.concatenate([x, x]) - self.mean
        self.sums, self.squares = (np.concatenate([[0.0], np.cumsum(d)]) for d in (dev, dev * dev))
        change = np.flatnonzero(x != np.roll(x, -1))  # an arc from i is constant up to the next change
        self.run = np.full(len(x), len(x) + 1) if not len(change) else (
            np.concatenate([change, change + len(x)])[np.searchsorted(change, np.arange(len(x)))] - np.arange(len(x)) + 1)

    def sharpe(self, starts: np.ndarray, lengths: np.ndarray, per_year: float) -> float | None:
        """Annualised Sharpe of the arcs' values put together; None where they do not vary."""
        n = len(self.x)
        if n < 2 or ((lengths <= self.run[starts]).all() and (self.x[starts] == self.x[starts[0]]).all()):
            return None
        s = (self.sums[starts + lengths] - self.sums[starts]).sum()
        q = (self.squares[starts + lengths] - self.squares[starts]).sum()
        sd = math.sqrt(max(q - s * s / n, 0.0) / (n - 1))
        return float((self.mean + s / n) / sd * math.sqrt(per_year)) if sd >= TINY else None


def replicated(lists: DataFrame, keys: list[str], values: list[str], n_boot: int, seed: int, usable: Column | None = None) -> DataFrame:
    """Every cell row of ``lists`` (n, block, per_year, v_ lists) once per replicate, with ``rep`` and the Sharpe ``s_`` of each value; a
    cell that is not ``usable`` once, with NULL."""
    chunks = F.when(F.lit(True) if usable is None else usable, F.sequence(F.lit(0), F.lit(max(n_boot - 1, 0)), F.lit(CHUNK))).otherwise(F.array(F.lit(-1)))
    dealt = lists.withColumns({"_cell": cell_name(keys), "_first": F.explode(chunks)}).repartition(*keys, "_first")
    kept = [f for f in lists.schema if not f.name.startswith("v_")]
    schema = T.StructType([*kept, T.StructField("rep", T.IntegerType()), *[T.StructField(f"s_{v}", T.DoubleType()) for v in values]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, block, year, cell, first = (batch.column(c).to_pylist() for c in ("n", "block", "per_year", "_cell", "_first"))
            for i in range(batch.num_rows):
                reps = range(first[i], min(first[i] + CHUNK, n_boot)) if first[i] >= 0 else [None]
                circles = [Circle(batch.column(f"v_{v}")[i].values.to_numpy(zero_copy_only=False)) for v in values]
                drawn = [block_draws(seed, cell[i], r, n[i], block[i]) if r is not None else None for r in reps]
                sharpes = [[c.sharpe(*d, year[i]) if d else None for d in drawn] for c in circles]
                same = pa.array([i] * len(reps), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(same) for f in kept), pa.array(list(reps), pa.int32()),
                                                  *(pa.array(x, pa.float64()) for x in sharpes)], schema=arrow)

    return dealt.mapInArrow(run, schema)


def point_of(v: str) -> Column:
    """Sharpe of a list ``v_`` under ``per_year``."""
    x, n = F.col(f"v_{v}"), F.col("n")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)

    def around(mean: Column) -> Column:
        sd = F.sqrt(total(F.transform(x, lambda e: (e - mean) * (e - mean))) / F.greatest(n - 1, F.lit(1)))
        return let(sd, lambda s: F.when(s >= TINY, mean / s * F.sqrt("per_year")))

    return F.when((n >= 2) & (F.array_max(x) > F.array_min(x)), let(total(x) / n, around))


def cells_of(rows: DataFrame, keys: list[str], values: list[str], block: float | str | None, horizon: str) -> DataFrame:
    """One row per cell: n, block, per_year, lists and the point Sharpes ``point_``."""
    carry = {"per_year": F.first(periods(horizon))}
    if "block" in rows.columns:
        lists = series_of(rows, keys, values, {**carry, "block": F.first("block")})
    else:
        lists = with_cell_block(series_of(rows, keys, values, carry), values, block)
    return lists.withColumns({f"point_{v}": point_of(v) for v in values})


def resample(rows: DataFrame, keys: list[str], n_boot: int, seed: int, block: str = "block") -> DataFrame:
    """Resampled positions: ``rep, i, pick`` for every cell, replicate and position."""
    cells = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.first(block).alias("block")).withColumns(
        {"_cell": cell_name(keys), "rep": F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))})
    kept = [cells.schema[k] for k in keys]
    schema = T.StructType([*kept, T.StructField("rep", T.IntegerType()), T.StructField("i", T.LongType()), T.StructField("pick", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, size, cell, rep = (batch.column(c).to_pylist() for c in ("n", "block", "_cell", "rep"))
            for i in range(batch.num_rows):
                starts, lengths = block_draws(seed, cell[i], rep[i], n[i], size[i])
                place = np.arange(n[i])
                pick = (np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + place) % n[i]
                same = pa.array([i] * n[i], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(same) for f in kept), batch.column("rep").take(same).cast(pa.int32()),
                                                  pa.array(place), pa.array(pick)], schema=arrow)

    return cells.mapInArrow(run, schema)


def replicate_sharpes(rows: DataFrame, keys: list[str], values: list[str], n_boot: int, seed: int, horizon: str = "horizon") -> DataFrame:
    """Sharpe of every value column per (cell, replicate); all columns share the draws of ``resample``."""
    cells = cells_of(rows, keys, values, None, horizon)
    return replicated(cells, keys, values, n_boot, seed).select(*keys, "rep", *[f"s_{v}" for v in values])


def stationary_bootstrap(ts: DataFrame, keys: list[str], n_boot: int = 2000, block: float | str | None = None,
                         seed: int = 42, col: str = "net", horizon: str = "horizon") -> DataFrame:
    """Sharpe per (cell, replicate)."""
    cells = cells_of(indexed(ts, keys, [col]), keys, [col], block, horizon)
    return replicated(cells, keys, [col], n_boot, seed).select(*keys, "rep", f"s_{col}")


def percentiles(col: str, name: str) -> list[Column]:
    p = F.percentile(col, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return [p[0].alias(f"{name}_lo"), p[1].alias(f"{name}_md"), p[2].alias(f"{name}_hi")]


def sharpe_ci(ts: DataFrame, keys: list[str], n_boot: int = 2000, block: float | str | None = None, seed: int = 42,
              force: bool = False, col: str = "net", horizon: str = "horizon") -> DataFrame:
    """Percentile interval, standard error and the point's own percentile; cells below six rows are refused."""
    cells = cells_of(indexed(ts, keys, [col]), keys, [col], block, horizon)
    reps = replicated(cells, keys, [col], n_boot, seed, None if force else F.col("n") >= N_HARD)
    point, drawn = F.col(f"point_{col}"), F.col(f"s_{col}")
    # A replicate equal to the point up to summation order is not below it.
    below = F.avg((drawn < point - 1e-9).cast("double")) * 100.0
    ci = reps.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("block").alias("block"), F.first(point).alias(f"point_{col}"),
        *percentiles(f"s_{col}", "sharpe"), F.stddev_samp(f"s_{col}").alias("boot_se"), below.alias("point_percentile"))
    return ci.withColumn("status", F.when(F.col("n") < N_HARD, "refused").when(F.col("n") < N_WARN, "small").otherwise("ok"))


def paired_bootstrap(pairs: DataFrame, keys: list[str], n_boot: int = 2000, block: float | str | None = None,
                     seed: int = 42, horizon: str = "horizon", studentized: bool = False) -> DataFrame:
    """Intervals of both Sharpes and their difference from shared draws; one-sided p = share(diff <= 0).

    ``studentized`` adds the interval of (diff - point)/se reflected around the point (from 100 replicates on).
    """
    cells = cells_of(pairs, keys, ["a", "b"], block, horizon)
    reps = replicated(cells, keys, ["a", "b"], n_boot, seed)
    both = F.col("s_a").isNotNull() & F.col("s_b").isNotNull()
    reps = reps.withColumns({"s_a": F.when(both, F.col("s_a")), "s_b": F.when(both, F.col("s_b"))}).withColumn("s_diff", F.col("s_a") - F.col("s_b"))
    out = reps.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("n", "block", "point_a", "point_b")], F.first(F.col("point_a") - F.col("point_b")).alias("point_diff"),
        F.when(F.count("s_diff") > 0, F.count("s_diff")).alias("n_valid"), *percentiles("s_a", "a"), *percentiles("s_b", "b"), *percentiles("s_diff", "diff"),
        F.avg((F.col("s_diff") <= 0).cast("double")).alias("p_one_sided"), F.stddev_samp("s_diff").alias("se_diff"))
    if not studentized:
        return out
    # Quantiles of (diff - point)/se are those of diff, shifted and scaled, so the reflected interval needs no second pass.
    enough = (F.col("n_valid") >= N_REPLICATES) & (F.col("se_diff") >= TINY)
    return out.withColumns({
        "student_lo": F.when(enough, 2 * F.col("point_diff") - F.col("diff_hi")),
        "student_hi": F.when(enough, 2 * F.col("point_diff") - F.col("diff_lo"))})


def paired_by_cell(a: DataFrame, b: DataFrame, keys: list[str], min_n: int = N_HARD, n_boot: int = 2000,
                   seed: int = 2026, col: str = "net", horizon: str = "horizon", block: float | str | None = "auto") -> DataFrame:
    """Paired bootstrap per cell on every H-th row; cells with fewer than ``min_n`` such pairs use all rows.

    The block is the mean of both arms' plug-in lengths; the fallback floors it at the horizon and annualises as daily. Every
    cell with a pair is answered: ``status`` is "refused" (fewer than ``min_n`` pairs even so, no interval), "few" (fewer than
    100 valid replicates) or "ok".
    """
    sparse = lambda ts: ts.where(F.col("row_idx") % F.col(horizon) == 0)
    h = a.select(*keys, horizon).distinct()
    grid = pair_arms(sparse(a), sparse(b), keys, col).where(F.col("n") >= min_n).withColumn("used_overlap", F.lit(False))
    daily = pair_arms(a, b, keys, col).withColumn("used_overlap", F.lit(True))
    daily = daily.join(grid.select(*keys).distinct(), keys, "left_anti")
    rows = grid.unionByName(daily).join(h, keys) if horizon not in keys else grid.unionByName(daily)
    rows = with_block(rows, block, keys, ["a", "b"]).withColumns({
        "block": F.when(F.col("used_overlap"), F.greatest("block", F.col(horizon).cast("double"))).otherwise(F.col("block")),
        "eff_horizon": F.when(F.col("used_overlap"), 1).otherwise(F.col(horizon))})
    out = paired_bootstrap(rows.where(F.col("n") >= min_n), keys, n_boot, None, seed, "eff_horizon").drop("n", "block")
    cells = rows.groupBy(*keys).agg(F.first("used_overlap").alias("used_overlap"), F.first("n").alias("n"), F.first("block").alias("block"))
    status = F.when(F.col("n") < min_n, "refused").when(F.coalesce("n_valid", F.lit(0)) < N_REPLICATES, "few").otherwise("ok")
    return cells.join(out, keys, "left").withColumn("status", status)
