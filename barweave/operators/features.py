"""Bar-level expressions and rolling features.

Bars are unique per (entity, date), so one entity's window holds at most one
row per calendar day; that bound does not grow with the article or trade
volume behind the bars.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.functions.maths import TINY, as_col, at_least, inf_to_null
from barweave.operators.frames import Frames, by_whole_entities, log

EPS = 1e-9
TRADING_DAYS = 252.0

# Window lengths per feature family.
WINDOWS = [5, 10, 20, 30, 60]
VOLUME_PRICE_WINDOWS = [10, 20, 60]
MOMENTUM_WINDOWS = [5, 10, 20]
SENTIMENT_WINDOWS = [5, 20]
KLINE = ["KMID", "KLEN", "KMID2", "KUP", "KLOW", "KSFT", "KSFT2"]


def feature_names() -> list[str]:
    """The 63 feature columns in canonical order."""
    families = [(f, WINDOWS) for f in ("RET", "MA", "STD", "MAX", "MIN", "RANK", "HL", "VMA", "VSTD")]
    families += [("CORR", VOLUME_PRICE_WINDOWS), ("MOM", MOMENTUM_WINDOWS)]
    names = KLINE + [f"{f}_{d}" for f, ds in families for d in ds]
    return names + ["SENT_DELTA"] + [f"SENT_{f}_{d}" for f in ("MA", "STD") for d in SENTIMENT_WINDOWS]


def by_entity(entity: str = "entity", date: str = "date") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(date)


def trailing(w: WindowSpec, d: int) -> WindowSpec:
    return w.rowsBetween(-(d - 1), 0)


def full_frame(value: Column, counted, w: WindowSpec, d: int) -> Column:
    """``value`` once the trailing frame holds ``d`` non-null entries of ``counted``."""
    return F.when(F.count(as_col(counted)).over(trailing(w, d)) == d, value)


# ---- row-wise expressions ------------------------------------------------

def adjust_ohlc(df: DataFrame, adj: str = "adj_close") -> DataFrame:
    """Scale open, high, low and close by adj_close / close; a missing adj_close means no change."""
    close = F.col("close")
    factor = F.coalesce(F.col(adj), close) / F.when(close > EPS, close).otherwise(1.0)
    return df.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close")})


def log1p_volume(col="volume") -> Column:
    return F.log1p(at_least(col, 0.0))


def kline(df: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    base, span = at_least(o, EPS), at_least(h - l, EPS)
    return df.withColumns({
        "KMID": (c - o) / base,
        "KLEN": (h - l) / base,
        "KMID2": (c - o) / span,
        "KUP": (h - F.greatest(o, c)) / base,
        "KLOW": (F.least(o, c) - l) / base,
        "KSFT": (2.0 * c - h - l) / base,
        "KSFT2": (2.0 * c - h - l) / span,
    })


# ---- rolling families -------------------------------------------------------
#
# Every value comes from its own trailing frame, so a missing or odd bar affects the frames that hold it and no
# later one. Frames of all lengths are built from those of power-of-two length (``frames``).

def finite(col: str) -> Column:
    """NaN and infinity count as missing."""
    x = F.col(col).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


INPUTS = {"_c": "close", "_h": "high", "_low": "low", "_s": "scaled_sentiment", "_v": "volume"}


def ingredients(rows: pa.Table, at: np.ndarray) -> Frames:
    """Shared inputs: finite prices, 1-row log return, floored volume, its log and change, and the pairs known in both."""
    f = Frames({c: rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in INPUTS if c in rows.column_names}, at)
    if "_v" in f.columns:
        f.columns["_v"] = np.maximum(f["_v"], 1.0)
        f.columns["_lv"] = log(f["_v"])
    if "_c" in f.columns:
        f.columns["_r"] = log_return(f, 1)
    if "_r" in f.columns and "_lv" in f.columns:
        change = f["_lv"] - f.earlier(f["_lv"], 1)
        both = ~np.isnan(f["_r"]) & ~np.isnan(change)
        f.columns |= {"_x": np.where(both, f["_r"], np.nan), "_y": np.where(both, change, np.nan)}
    return f


def log_return(f: Frames, d: int) -> np.ndarray:
    return log(f["_c"] / np.maximum(f.earlier(f["_c"], d), EPS))


def momentum(f: Frames, d: int) -> np.ndarray:
    past = f.earlier(f["_c"], d)
    return (f["_c"] - past) / (past + EPS)


# family -> value over the frames of a length
FAMILIES = {
    "RET": log_return,
    "MA": lambda f, d: f["_c"] / (f.mean("_c", d) + EPS) - 1.0,
    "STD": lambda f, d: f.stddev("_r", d),
    "MAX": lambda f, d: f.known("_c", d, f.extreme("hi", "_c", d) / (f["_c"] + EPS) - 1.0),
    "MIN": lambda f, d: f.known("_c", d, f.extreme("lo", "_c", d) / (f["_c"] + EPS) - 1.0),
    "RANK": lambda f, d: f.rank("_c", d),
    "HL": lambda f, d: f.known("_c", d, (f.extreme("hi", "_h", d) - f.extreme("lo", "_low", d)) / (f["_c"] + EPS)),
    "VMA": lambda f, d: f["_v"] / (f.mean("_v", d) + EPS) - 1.0,
    "VSTD": lambda f, d: f.stddev("_lv", d),
    "CORR": lambda f, d: f.corr("_x", "_y", d, TINY),
    "MOM": momentum,
    "SENT_MA": lambda f, d: f.mean("_s", d) - 0.5,
    "SENT_STD": lambda f, d: f.stddev("_s", d),
}


def rolling(bars: DataFrame, names: list[str], entity: str = "entity", date: str = "date", complete: list[str] = [], min_rows: int = 0) -> DataFrame:
    """Add the named rolling features, of any window length. Where ``complete`` names columns, rows that miss one of them are
    dropped, then entities left with fewer than ``min_rows``, as ``complete_rows`` does, by the task that holds the entity."""
    rows = bars if "scaled_sentiment" in bars.columns else bars.withColumn("scaled_sentiment", F.lit(0.5))
    kept = [c for c in rows.columns if c not in names]
    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(n, T.DoubleType()) for n in names]])

    def work(table: pa.Table, number: np.ndarray, at: np.ndarray) -> pa.Table:
        frames = ingredients(table, at)
        out = table.select(kept)
        for name in names:
            family, _, d = name.rpartition("_")
            value = FAMILIES[family](frames, int(d)) if family in FAMILIES else frames["_s"] - 0.5  # SENT_DELTA
            out = out.append_column(name, pa.array(np.where(np.isfinite(value), value, np.nan), from_pandas=True))
        if complete:
            whole = np.logical_and.reduce([out[c].is_valid().to_numpy() for c in complete])
            out = out.filter(pa.array(whole & (np.bincount(number, whole)[number] >= min_rows)))
        return out

    inputs = {name: finite(c) for name, c in INPUTS.items() if c in rows.columns}
    return by_whole_entities(rows.withColumns(inputs), entity, date, schema, work)


def alpha_features(bars: DataFrame, entity: str = "entity", date: str = "date", complete: list[str] = [], min_rows: int = 0) -> DataFrame:
    """All 63 features: one exchange and one sort by entity, shared by every frame; ``complete`` and ``min_rows`` as in ``rolling``."""
    shaped = inf_to_null(kline(bars), KLINE)
    rolled = rolling(shaped, [n for n in feature_names() if n not in KLINE], entity, date, complete, min_rows)
    return rolled.select(*bars.columns, *feature_names())


def complete_rows(df: DataFrame, cols: list[str], min_rows: int = 100, entity: str = "entity") -> DataFrame:
    """Drop rows with a missing feature, then entities left with fewer than ``min_rows``."""
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in cols])
    own = Window.partitionBy(entity)
    counted = df.withColumn("_known", known).withColumn("_n", F.count_if("_known").over(own))
    return counted.where(F.col("_known") & (F.col("_n") >= min_rows)).drop("_known", "_n")


def prepared_bars(bars: DataFrame, min_rows: int = 100, entity: str = "entity", date: str = "date") -> DataFrame:
    """Model input from daily bars: prices adjusted, all features, log volume, complete rows only, entities with ``min_rows``
    of them. ``close`` is the adjusted close, the base of return targets."""
    adjusted = adjust_ohlc(bars).withColumn("log_volume", log1p_volume())
    out = alpha_features(adjusted, entity, date, [*feature_names(), "log_volume"], min_rows)
    return out.select(*[c for c in adjusted.columns if c != "log_volume"], *feature_names(), "log_volume")


# ---- volatility ------------------------------------------------------------

def realized_vol(bars: DataFrame, span: int = 20, entity: str = "entity", date: str = "date",
                 out: str = "realized_vol") -> DataFrame:
    """Sample deviation of the last ``span`` log returns (closes floored at 1e-6), annualised."""
    w = by_entity(entity, date)
    floor = at_least(F.col("close"), 1e-6)
    step = bars.withColumn("_lc", F.ln(floor)).withColumn("_r", F.col("_lc") - F.lag("_lc").over(w))
    value = full_frame(F.stddev_samp("_r").over(trailing(w, span)), "_r", w, span)
    return step.withColumn(out, value * F.sqrt(F.lit(TRADING_DAYS))).drop("_lc", "_r")


def log_vol_target(df: DataFrame, col: str = "close_z", lookback: int = 20, entity: str = "entity",
                   date: str = "date", out: str = "log_vol_target") -> DataFrame:
    """ln(population deviation of the last ``lookback`` differences + 1e-3)."""
    w = by_entity(entity, date)
    step = df.withColumn("_d", F.col(col) - F.lag(col).over(w))
    value = full_frame(F.stddev_pop("_d").over(trailing(w, lookback)), "_d", w, lookback)
    return step.withColumn(out, F.ln(value + 1e-3)).drop("_d")


def vol_zscore(df: DataFrame, span: int = 40, col: str = "realized_vol", keys: list[str] | None = None,
               date: str = "date", out: str = "vol_z") -> DataFrame:
    """Z-score of each value against the previous ``span`` rows, the current row excluded."""
    keys = keys or ["entity"]
    w = Window.partitionBy(*keys).orderBy(date)
    prior = w.rowsBetween(-span, -1)
    value = (F.col(col) - F.avg(col).over(prior)) / (F.stddev_samp(col).over(prior) + 1e-12)
    return df.withColumn(out, F.when(F.row_number().over(w) > span, value))
