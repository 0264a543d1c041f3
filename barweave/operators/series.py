"""Per-series helpers: decomposition, averages, normalisation, anomaly runs, spectra and lags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barweave.functions.maths import TINY
from barweave.operators.features import by_entity
from barweave.operators.ordering import last_before


def series_decompose(df: DataFrame, col: str, kernel: int = 25, entity: str = "entity", date: str = "date") -> DataFrame:
    """Centred moving average with the edge values repeated outside the series, and the residual."""
    w = by_entity(entity, date)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = (kernel - 1) // 2, kernel // 2
    frame = w.rowsBetween(-before, after)
    rows = df.withColumns({
        "_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(entity)),
        "_a": F.first(col).over(whole), "_z": F.last(col).over(whole), "_s": F.sum(col).over(frame)})
    head = F.greatest(F.lit(0), before + 1 - F.col("_i"))
    tail = F.greatest(F.lit(0), F.col("_i") + after - F.col("_n"))
    trend = (F.col("_s") + head * F.col("_a") + tail * F.col("_z")) / float(kernel)
    return rows.withColumn("trend", trend).withColumn("residual", F.col(col) - F.col("trend")).drop("_i", "_n", "_a", "_z", "_s")


BLOCK = 32


def block_states(ends: DataFrame, factor: float, entity: str) -> DataFrame:
    """State entering each block: S_b = factor·S_(b-1) + end_b, S before the first block being 0.

    The folded list has one entry per ``BLOCK`` rows of an entity.
    """
    pairs = F.array_sort(F.collect_list(F.struct("block", "end")))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<struct<block:bigint,carry:double>>").alias("out"))

    def step(acc, row):
        entry = F.struct(row["block"].alias("block"), acc["s"].alias("carry"))
        return F.struct((acc["s"] * factor + row["end"]).alias("s"), F.concat(acc["out"], F.array(entry)).alias("out"))

    lists = ends.groupBy(entity).agg(pairs.alias("_p"))
    return lists.select(entity, F.explode(F.aggregate("_p", start, step, lambda acc: acc["out"])).alias("_r")).select(
        entity, "_r.block", "_r.carry")


def discounted(df: DataFrame, col: str, decay: float, entity: str, date: str) -> DataFrame:
    """s_t = decay·s_(t-1) + (1-decay)·x_t from zero as ``_s``, with the 1-based row number ``t``.

    Blocks of ``BLOCK`` rows are folded row by row, which holds for any decay from 0 to 1; then the block ends are folded.
    """
    rows = df.where(F.col(col).isNotNull()).withColumn("t", F.row_number().over(by_entity(entity, date)))
    rows = rows.withColumns({"block": F.floor((F.col("t") - 1) / BLOCK), "_j": (F.col("t") - 1) % BLOCK})
    power = lambda k: F.pow(F.lit(decay), k)
    inside = Window.partitionBy(entity, "block").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    folded = F.aggregate(F.collect_list(F.col(col).cast("double")).over(inside), F.lit(0.0), lambda acc, x: acc * decay + x)
    rows = rows.withColumn("_local", (1.0 - decay) * folded)
    ends = rows.where(F.col("_j") == BLOCK - 1).select(
        entity, F.col("block").cast("long").alias("block"), F.col("_local").alias("end"))
    carried = block_states(ends, decay ** BLOCK, entity).withColumn("_after", F.col("carry") * decay ** BLOCK)
    known = carried.join(ends, [entity, "block"]).select(
        entity, (F.col("block") + 1).alias("block"), (F.col("_after") + F.col("end")).alias("_carry"))
    out = rows.join(known, [entity, "block"], "left")
    return out.withColumn("_s", F.col("_local") + power(F.col("_j") + 1) * F.coalesce("_carry", F.lit(0.0))).drop(
        "block", "_j", "_local", "_carry")


def ema(df: DataFrame, col: str, decay: float, entity: str = "entity", date: str = "date", out: str = "ema") -> DataFrame:
    """Exponential average started at zero and divided by its accumulated weight 1 - decay^t."""
    rows = discounted(df, col, decay, entity, date)
    return rows.withColumn(out, F.col("_s") / (1.0 - F.pow(F.lit(decay), F.col("t")))).drop("_s", "t")


def exp_smoothing(df: DataFrame, col: str, alpha: float, v0: float = 0.0, entity: str = "entity", date: str = "date",
                  out: str = "smoothed") -> DataFrame:
    """s_t = (1-alpha)·sum alpha^(t-i)·x_i + alpha^(t+1)·v0, t counted from 0."""
    rows = discounted(df, col, alpha, entity, date)
    return rows.withColumn(out, F.col("_s") + F.pow(F.lit(alpha), F.col("t")) * v0).drop("_s", "t")


def window_normalize(df: DataFrame, cols: list[str], length: int, subtract_last: bool = False, entity: str = "entity",
                     date: str = "date", eps: float = 1e-5) -> DataFrame:
    """Adds ``wn_``, ``wm_`` (centre) and ``ws_`` (scale) of each column over the trailing window."""
    w = by_entity(entity, date)
    held = w.rowsBetween(-(length - 1), 0)
    rows = df.withColumn("_rn", F.row_number().over(w))
    for c in cols:
        centre = F.col(c) if subtract_last else F.avg(c).over(held)
        rows = rows.withColumns({f"wm_{c}": centre, f"ws_{c}": F.sqrt(F.var_pop(c).over(held) + eps)})
        rows = rows.withColumn(f"wn_{c}", (F.col(c) - F.col(f"wm_{c}")) / F.col(f"ws_{c}"))
    return rows.where(F.col("_rn") >= length).drop("_rn")


def window_denormalize(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(f"wn_{c}") * F.col(f"ws_{c}") + F.col(f"wm_{c}") for c in cols})


def point_adjust(df: DataFrame, truth: str, pred: str, entity: str = "entity", order: str = "event_id",
                 slot: Column | None = None) -> DataFrame:
    """Inside a run of true-anomaly rows any hit marks the whole run.

    A run is named by the last normal row before it, found slot by slot, so a very active entity is
    spread over many tasks; hits are then counted per run by a partial aggregation.
    """
    slot = F.floor(F.col(order) / 4096) if slot is None else slot
    rows = last_before(df, [entity], order, slot, ~F.col(truth), "_run").withColumn("_run", F.coalesce("_run", F.lit(-1)))
    hits = rows.where(F.col(truth) & F.col(pred)).groupBy(entity, "_run").agg(F.lit(True).alias("_hit"))
    joined = rows.join(hits, [entity, "_run"], "left")
    marked = F.when(F.col(truth), F.coalesce(F.col("_hit"), F.lit(False))).otherwise(F.col(pred))
    return joined.withColumn("adjusted", marked).drop("_run", "_hit")


def series_lists(df: DataFrame, col: str, entity: str, date: str) -> DataFrame:
    """(entity, x): the known values of each entity in time order. A series has one value per date, so a list is bounded by the
    calendar; the exchange carries rows once, whatever is computed from them."""
    known = df.where(F.col(col).isNotNull()).select(F.col(entity), F.struct(F.col(date).alias("at"), F.col(col).cast("double").alias("x")).alias("_p"))
    lists = known.groupBy(entity).agg(F.array_sort(F.collect_list("_p")).alias("_s"))
    return lists.select(entity, F.transform("_s", lambda p: p["x"]).alias("x"))


def per_series(lists: DataFrame, entity: str, fields: str, work: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """One row per element of what ``work`` makes of each series: columns ``fields``, as equally long arrays."""
    schema = T.StructType([lists.schema[entity], *T.StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [work(values.values.to_numpy(zero_copy_only=False)) for values in batch.column("x")]
            owner = pa.array(np.repeat(np.arange(len(made)), [len(m[0]) for m in made]), pa.int64())
            columns = [pa.array(np.concatenate([m[k] for m in made]) if made else [], arrow.field(k + 1).type) for k in range(len(arrow) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(entity).take(owner), *columns], schema=arrow)

    return lists.mapInArrow(run, schema)


def strongest(amplitude: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to earlier ones."""
    return np.argsort(-amplitude, kind="stable")[:k]


def dominant_periods(df: DataFrame, col: str, k: int = 2, max_t: int | None = None, entity: str = "entity",
                     date: str = "date") -> DataFrame:
    """Top ``k`` non-zero frequencies by Fourier amplitude per entity, with period n // f.

    The whole series is analysed unless ``max_t`` asks for its last rows only (as a model input length would). The transform is a
    fast one for any length, prime ones included: n log n steps an entity.
    """
    def spectrum(x: np.ndarray) -> list[np.ndarray]:
        x = x if max_t is None else x[-max_t:]
        n = len(x)
        size = np.abs(np.fft.rfft(x - x.mean()))[1:n // 2 + 1] if n > 1 else np.zeros(0)  # the level has frequency 0 only
        best = strongest(size, k)
        freq = best + 1
        return [np.arange(1, len(best) + 1), freq, n // freq, size[best]]

    return per_series(series_lists(df, col, entity, date), entity, "rank int, freq int, period bigint, amplitude double", spectrum)


#: Lags with fewer pairs than this are summed directly, where the transform's rounding would show.
FEW = 32


def lag_correlations(x: np.ndarray, lags: int, circular: bool) -> np.ndarray:
    """Pearson correlation of the series with itself at lags 1..``lags``, NaN where a side is constant; from the power spectrum."""
    n = len(x)
    if n < 2 or lags < 1:
        return np.zeros(0)
    y = x - x.mean()
    size = n if circular else 2 * n
    power = np.abs(np.fft.rfft(y, size)) ** 2
    shared = np.fft.irfft(power, size)[1:lags + 1]
    if circular:
        return np.full(lags, np.nan) if (x == x[0]).all() else np.clip(shared / (y * y).sum(), -1, 1)
    m = n - np.arange(1, lags + 1)
    sums, squares = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
    late, early = (sums[n] - sums[n - m], squares[n] - squares[n - m]), (sums[m], squares[m])
    spread = [np.maximum(q - s * s / m, 0.0) for s, q in (late, early)]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.clip((shared - late[0] * early[0] / m) / np.sqrt(spread[0] * spread[1]), -1, 1)
    for k in range(max(1, n - FEW), lags + 1):
        a, b = x[k:], x[:n - k]
        sa, sb = a.std(), b.std()
        out[k - 1] = ((a - a.mean()) * (b - b.mean())).mean() / (sa * sb) if sa > TINY and sb > TINY else np.nan
    changed = np.flatnonzero(x[1:] != x[:-1])
    first, last = (changed[0] + 1, n - 1 - changed[-1]) if len(changed) else (n, n)
    out[m <= max(first, last)] = np.nan  # the first or last m values are all the same
    return out


def autocorr_top_lags(df: DataFrame, col: str, max_lag: int | None = None, factor: float = 1.0, k: int | None = None,
                      circular: bool = False, entity: str = "entity", date: str = "date") -> DataFrame:
    """Strongest lags of each entity's autocorrelation with softmax weights.

    All lags from 1 to n-1 are tried unless ``max_lag`` asks for fewer; ``k`` defaults to floor(factor·ln n). ``circular``
    wraps around the end of the series. All lags come from one power spectrum: n log n steps an entity.
    """
    def top(x: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        r = lag_correlations(x, n - 1 if max_lag is None else min(max_lag, n - 1), circular)
        lag = np.flatnonzero(~np.isnan(r))
        # A circular series gives lags k and n-k the same value; rounding keeps the smaller one first.
        order = np.round(r[lag], 9) if circular else np.round(r[lag], 12)
        best = lag[strongest(order, k if k is not None else int(np.floor(factor * np.log(n))) if n else 0)]
        weight = np.exp(r[best] - r[best].max(initial=-1.0))
        return [np.arange(1, len(best) + 1), best + 1, r[best], weight / max(weight.sum(), 1e-300)]

    return per_series(series_lists(df, col, entity, date), entity, "rank int, lag int, autocorr double, weight double", top)
