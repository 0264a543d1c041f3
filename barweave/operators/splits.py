"""Scalers, walk-forward folds, purged sample splits and sample windows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date as Date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.maths import safe_div
from barweave.operators.features import by_entity, trailing


@dataclass(frozen=True)
class Fold:
    """Expanding window: train up to ``train_end``, then one validation and one test year."""

    name: str
    train_end: Date
    val_year: int
    test_year: int

    @property
    def val_start(self) -> Date:
        return Date(self.val_year, 1, 1)

    @property
    def val_end(self) -> Date:
        return Date(self.val_year, 12, 31)

    @property
    def test_start(self) -> Date:
        return Date(self.test_year, 1, 1)

    @property
    def test_end(self) -> Date:
        return Date(self.test_year, 12, 31)


def yearly_folds(first_train_year: int, n: int) -> list[Fold]:
    """``n`` consecutive folds F1, F2, ... with train ends one year apart."""
    return [Fold(f"F{i + 1}", Date(y, 12, 31), y + 1, y + 2)
            for i, y in enumerate(range(first_train_year, first_train_year + n))]


def fold_table(years: DataFrame, min_train_years: int = 3, year: str = "year") -> DataFrame:
    """Folds read off the years present in the data (one row per usable train-end year)."""
    span = years.agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    first = span.select((F.col("lo") + min_train_years - 1).alias("v")).scalar()
    last = span.select((F.col("hi") - 2).alias("v")).scalar()
    y = F.col(year)
    day = lambda yr, m, d: F.make_date(yr, F.lit(m), F.lit(d))
    kept = years.select(year).distinct().where((y >= first) & (y <= last))
    return kept.select(
        F.concat(F.lit("F"), (y - first + 1).cast("string")).alias("fold"),
        day(y, 12, 31).alias("train_end"),
        day(y + 1, 1, 1).alias("val_start"), day(y + 1, 12, 31).alias("val_end"),
        day(y + 2, 1, 1).alias("test_start"), day(y + 2, 12, 31).alias("test_end"))


def sample_index(bars: DataFrame, length: int, horizons: list[int], entity: str = "entity", date: str = "date",
                 min_close: float = 1e-6) -> DataFrame:
    """One row per (entity, anchor, horizon) with a full look-back and a known target.

    All horizons come from one window pass; a sample is dropped when either close is <= ``min_close``.
    """
    w = by_entity(entity, date)
    out = bars.withColumn("_rn", F.row_number().over(w))
    ahead = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lead("close", h).over(w).alias("target_close"),
                 F.lead(date, h).over(w).alias("target_date")) for h in horizons])
    out = out.withColumn("_ahead", ahead).where(F.col("_rn") >= length)
    out = out.withColumn("_t", F.explode("_ahead")).select(
        *bars.columns, (F.col("_rn") - 1).alias("anchor_idx"), (F.col("_rn") - length).alias("start_idx"),
        F.col("_t.horizon").alias("horizon"), F.col("_t.target_close").alias("target_close"),
        F.col("_t.target_date").alias("target_date"))
    valid = (F.col("close") > min_close) & (F.col("target_close") > min_close)
    return out.where(valid).withColumn("y_logret", F.ln(F.col("target_close") / F.col("close")))


def samples(df: DataFrame, length: int, horizon: int, **names) -> DataFrame:
    return sample_index(df, length, [horizon], **names)


def split_of(fold: Fold, date: Column, target: Column, embargo_days: Column, purge: bool) -> Column:
    """Split label under one fold; the first matching rule wins, NULL means dropped."""
    lit = F.lit
    if not purge:
        return (
            F.when(date <= lit(fold.train_end), "train")
            .when(date.between(lit(fold.val_start), lit(fold.val_end)), "val")
            .when(date.between(lit(fold.test_start), lit(fold.test_end)), "test"))
    e = embargo_days
    return (
        F.when(target <= F.date_sub(lit(fold.train_end), e), "train")
        .when((date >= F.date_add(lit(fold.val_start), e)) & (target <= F.date_sub(lit(fold.val_end), e)), "val")
        .when((date >= F.date_add(lit(fold.test_start), e)) & (target <= lit(fold.test_end)), "test"))


def purged_split(df: DataFrame, folds: list[Fold], embargo: int | None = None, purge: bool = True,
                 date: str = "date") -> DataFrame:
    """Label every sample under every fold; samples in an embargo zone are dropped.

    The embargo (in rows, default the horizon) becomes ceil(1.4 x embargo) calendar days.
    Folds are a short literal list, so this is a map-side expansion and not a range join.
    """
    rows = F.col("horizon") if embargo is None else F.lit(embargo)
    days = F.ceil(rows * 7.0 / 5.0).cast("int")
    labels = F.array(*[
        F.struct(F.lit(f.name).alias("fold"), split_of(f, F.col(date), F.col("target_date"), days, purge).alias("split"))
        for f in folds])
    # Unlabelled rows are dropped after the expansion: a filter of the array would leave compiled code.
    return df.withColumn("_f", F.explode(labels)).select(*df.columns, "_f.fold", "_f.split").where(F.col("split").isNotNull())


def anchor_split(df: DataFrame, folds: list[Fold], date: str = "date") -> DataFrame:
    return purged_split(df, folds, purge=False, date=date)


def eligible_entities(bars: DataFrame, length: int, horizon: int, folds: list[Fold], entity: str = "entity",
                      date: str = "date") -> DataFrame:
    """(entity, fold) pairs with enough rows, enough train rows and at least one train sample."""
    per = bars.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(date) <= F.lit(f.train_end)).alias(f"_t_{f.name}") for f in folds])
    stacked = per.select(entity, "n_rows", F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("fold"), F.col(f"_t_{f.name}").alias("n_train")) for f in folds])).alias("_f"))
    enough = stacked.select(entity, "_f.fold", "n_rows", "_f.n_train").where(
        (F.col("n_rows") >= length + horizon) & (F.col("n_train") >= length + horizon))
    labelled = purged_split(sample_index(bars, length, [horizon], entity, date), folds, date=date)
    trained = labelled.where(F.col("split") == "train").groupBy(entity, "fold").agg(
        F.count(F.lit(1)).alias("n_train_samples"))
    return enough.join(trained, [entity, "fold"], "inner")


# ---- scalers ---------------------------------------------------------------

def fit_scaler(bars: DataFrame, folds: list[Fold], cols: list[str], entity: str = "entity",
               date: str = "date", beside: bool = False) -> DataFrame:
    """Mean and population deviation per (entity, fold) over rows up to the fold's train end.

    One aggregation serves all folds: rows are not multiplied by the fold count. ``beside`` gives the rows of ``bars`` instead, each
    with its entity's ``_m_<fold>_<col>`` and ``_s_<fold>_<col>``: rows already dealt by entity are then neither moved nor joined.
    """
    aggs = {}
    for f in folds:
        for c in cols:
            train = F.when(F.col(date) <= F.lit(f.train_end), F.col(c))
            aggs |= {f"_m_{f.name}_{c}": F.avg(train), f"_s_{f.name}_{c}": F.stddev_pop(train)}
    if beside:
        own = Window.partitionBy(entity)
        return bars.withColumns({n: a.over(own) for n, a in aggs.items()}).where(F.col(entity).isNotNull())
    per = bars.groupBy(entity).agg(*[a.alias(n) for n, a in aggs.items()])
    floor = floored_deviation
    rows = F.array(*[
        F.struct(F.lit(f.name).alias("fold"), *[x for c in cols for x in (
            F.col(f"_m_{f.name}_{c}").alias(f"mu_{c}"), floor(F.col(f"_s_{f.name}_{c}")).alias(f"sd_{c}"))])
        for f in folds])
    return per.select(entity, F.explode(rows).alias("_r")).select(entity, "_r.*").where(F.col(f"mu_{cols[0]}").isNotNull())


def floored_deviation(s: Column) -> Column:
    return F.when(s < 1e-9, 1.0).otherwise(s)


def apply_scaler(df: DataFrame, scaler: DataFrame | list[Fold], cols: list[str], keys: list[str] = ["entity"]) -> DataFrame:
    """Adds ``z_<col>``; both sides hash on the entity, so bars already keyed by it are not moved again. Where ``scaler`` names the
    folds, the rows carry what ``fit_scaler`` gave ``beside`` them, and the column ``fold`` tells which applies."""
    if isinstance(scaler, list):
        def own(kind: str, c: str) -> Column:
            return F.coalesce(*[F.when(F.col("fold") == f.name, F.col(f"_{kind}_{f.name}_{c}")) for f in scaler])

        held = [f"_{kind}_{f.name}_{c}" for kind in "ms" for f in scaler for c in cols]
        joined = df.withColumns({f"mu_{c}": own("m", c) for c in cols} | {f"sd_{c}": floored_deviation(own("s", c)) for c in cols})
        joined = joined.drop(*held).where(F.col(f"mu_{cols[0]}").isNotNull())
    else:
        joined = df.join(scaler, keys)
    return joined.withColumns({f"z_{c}": (F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}") for c in cols})


def fit_minmax(bars: DataFrame, cols: list[str], window: tuple[Date, Date] | None = None, entity: str = "entity",
               date: str = "date") -> DataFrame:
    """Per-entity minimum and maximum, over all rows or over a calendar window."""
    if window:
        bars = bars.where(F.col(date).between(*[F.lit(d) for d in window]))
    return bars.groupBy(entity).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])


def apply_minmax(df: DataFrame, scaler: DataFrame, cols: list[str], entity: str = "entity") -> DataFrame:
    """Adds ``mm_<col>``; a constant range divides by one."""
    span = lambda c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 1.0).otherwise(F.col(f"hi_{c}") - F.col(f"lo_{c}"))
    return df.join(scaler, entity).withColumns({f"mm_{c}": (F.col(c) - F.col(f"lo_{c}")) / span(c) for c in cols})


def standard_scale(col, mean, std, inverse: bool = False) -> Column:
    return col * std + mean if inverse else safe_div(col - mean, std)


# ---- windows ---------------------------------------------------------------

def windows(df: DataFrame, cols: list[str], length: int, entity: str = "entity", date: str = "date") -> DataFrame:
    """Attach the last ``length`` rows of ``cols`` as an array of structs; incomplete windows are dropped.

    Filter the anchors afterwards on a narrow frame: each output row carries ``length`` structs.
    """
    w = by_entity(entity, date)
    held = F.collect_list(F.struct(*cols)).over(trailing(w, length))
    return df.withColumn("_rn", F.row_number().over(w)).withColumn("x", held).where(F.col("_rn") >= length).drop("_rn")


def future_path(df: DataFrame, col: str, horizon: int, entity: str = "entity", date: str = "date") -> DataFrame:
    """Next ``horizon`` values as an array (the scaled-price target); rows without all of them are dropped."""
    ahead = by_entity(entity, date).rowsBetween(1, horizon)
    return df.withColumn("y_path", F.collect_list(col).over(ahead)).where(F.size("y_path") == horizon)


def patches(df: DataFrame, value: str, size: int, stride: int, pad: bool = False, entity: str = "entity",
            date: str = "date") -> DataFrame:
    """Strided sub-windows of each entity's series: ``patch`` number, ``pos`` inside it, ``value``.

    Each row is sent to the at most ceil(size / stride) patches that cover it; ``pad`` repeats the
    last value ``stride`` times at the end.
    """
    w = by_entity(entity, date)
    rows = df.select(entity, (F.row_number().over(w) - 1).alias("i"), F.col(value).alias("value"),
                     F.count(F.lit(1)).over(Window.partitionBy(entity)).alias("n"))
    if pad:
        extra = F.when(F.col("i") == F.col("n") - 1, stride).otherwise(0)
        rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), extra))).select(
            entity, (F.col("i") + F.col("_k")).alias("i"), "value", (F.col("n") + stride).alias("n"))
    first = F.greatest(F.ceil((F.col("i") - size + 1) / float(stride)), F.lit(0))
    last = F.least(F.floor(F.col("i") / stride), F.floor((F.col("n") - size) / stride))
    hit = F.when(first <= last, F.sequence(first, last))
    return rows.withColumn("patch", F.explode(hit)).select(
        entity, "patch", (F.col("i") - F.col("patch") * stride).alias("pos"), "value")


def calendar_split(bars: DataFrame, val_start: Date, test_start: Date, lookback: int, min_rows: int = 1,
                   entity: str = "entity", date: str = "date") -> DataFrame:
    """train / val / test rows by calendar, val and test prefixed by ``lookback`` context rows.

    A row may serve two splits; entities whose split (with context) is shorter than ``min_rows`` lose it.
    """
    whole = Window.partitionBy(entity)
    w = by_entity(entity, date)
    d = F.col(date)
    rows = bars.withColumn("_rn", F.row_number().over(w)).withColumns({
        "_v": F.count_if(d < F.lit(val_start)).over(whole), "_t": F.count_if(d < F.lit(test_start)).over(whole)})
    rn = F.col("_rn")
    role = lambda name, inside, context: F.when(inside, F.struct(F.lit(name).alias("split"), context.alias("is_context")))
    roles = F.array_compact(F.array(
        role("train", rn <= F.col("_v"), F.lit(False)),
        role("val", (rn > F.col("_v") - lookback) & (rn <= F.col("_t")), rn <= F.col("_v")),
        role("test", rn > F.col("_t") - lookback, rn <= F.col("_t"))))
    out = rows.withColumn("_s", F.explode(roles)).select(*bars.columns, "_s.split", "_s.is_context")
    n = F.count(F.lit(1)).over(Window.partitionBy(entity, "split"))
    return out.withColumn("_n", n).where(F.col("_n") >= min_rows).drop("_n")


def calendar_panel(rows: DataFrame, keys: list[str], order: list[str], entity: str = "entity",
                   date: str = "date") -> DataFrame:
    """One row per (keys, date, entity): the last one under ``order`` wins."""
    ids = [*keys, date, entity]
    values = [c for c in rows.columns if c not in ids]
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_row")
    return rows.groupBy(*ids).agg(last).select(*ids, "_row.*")


def panel_by_position(rows: DataFrame, mode: str = "intersect", entity: str = "entity", date: str = "date") -> DataFrame:
    """Align entities on their n-th sample; ``intersect`` keeps positions every entity has."""
    placed = rows.withColumn("pos", F.row_number().over(by_entity(entity, date)) - 1)
    if mode == "union":
        return placed
    shortest = placed.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m"))
    return placed.where(F.col("pos") < shortest.scalar())
