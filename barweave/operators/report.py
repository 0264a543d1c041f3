"""Cell summaries, headline views and experiment grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.functions.maths import as_col
from barweave.operators.inference import deflated_sharpe


def union_parts(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def intersect_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows replace existing rows with the same keys; NULL keys equal each other. Of new rows with equal keys the last under
    ``order`` stays, further ties being settled by a hash of the row; existing rows that nothing replaces stay as they are."""
    rank = [F.col(order)] if order is not None else []
    plain = [F.col(f.name) for f in new.schema if "map<" not in f.dataType.simpleString()]
    latest = new.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.max_by(F.struct(*new.columns), F.struct(*rank, F.xxhash64(*plain).alias("_hash"))).alias("_row"))
    replaced = latest.select([f"_key_{k}" for k in keys])
    same = reduce(lambda a, b: a & b, [existing[k].eqNullSafe(replaced[f"_key_{k}"]) for k in keys])
    return existing.join(replaced, same, "left_anti").unionByName(latest.select("_row.*"))


def cost_map(costs: DataFrame, keys: list[str], metrics: list[str], bps: str = "cost_bps") -> DataFrame:
    """Nest per-cost metric rows into one map per cell, keyed by the cost as text."""
    entry = F.struct(F.col(bps).cast("string").alias("k"), F.struct(*metrics).alias("v"))
    return costs.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("cost_sensitivity"))


def flatten_costs(summaries: DataFrame, keys: list[str], bps: list[float], metrics: list[str],
                  field: str = "cost_sensitivity") -> DataFrame:
    """One ``c{bps}_{metric}`` column per cost level and metric; a projection, nothing is exploded."""
    cols = [F.try_element_at(field, F.lit(str(float(b))))[m].alias(f"c{int(b)}_{m}") for b in bps for m in metrics]
    return summaries.select(*keys, *cols)


def pivot_arms(df: DataFrame, index: list[str], arms: list[str], metrics: list[str], arm: str = "arm", order: str | None = None) -> DataFrame:
    """One row per index; ``{metric}_{arm}`` columns hold that arm's known value, of several the first under ``order``, or the
    largest where no order is given."""
    def pick(m: str, a: str) -> Column:
        known = (F.col(arm) == a) & F.col(m).isNotNull()
        return F.max(F.when(known, F.col(m))) if order is None else F.min_by(F.col(m), F.when(known, F.col(order)))

    cols = [pick(m, a).alias(f"{m}_{a}") for m in metrics for a in arms]
    return df.groupBy(*index).agg(*cols)


def best_cell(summaries: DataFrame, metric: str, ids: list[str]) -> DataFrame:
    """The cell with the largest metric; ids break ties."""
    return summaries.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), *ids).limit(1)


def grid(cells: DataFrame, arms: list[str], horizons: list[int], done: DataFrame, keys: list[str]) -> DataFrame:
    """Every (cell, horizon, arm) that has no result yet; the option lists expand map-side."""
    full = cells.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn(
        "arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    return full.join(done.select(*keys), keys, "left_anti")


def trial_pool(summaries: DataFrame, keys: list[str], sweep: str = "sweep_topn", fallback: str = "ic_mean",
               sharpe: str = "net_sharpe", entry: str = "val_sharpe_gross") -> DataFrame:
    """Trial Sharpes per pool: every sweep entry; a cell without a sweep gives its IC mean; a pool with
    fewer than two trials gives its cell Sharpes."""
    listed = F.coalesce(F.col(sweep)[entry], F.array().cast("array<double>"))
    own = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.col(fallback)))
    long = summaries.select(*keys, F.explode(own).alias("sharpe")).where(F.col("sharpe").isNotNull())
    rich = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2).select(*keys)
    cells = summaries.select(*keys, F.col(sharpe).alias("sharpe")).where(F.col("sharpe").isNotNull())
    return long.join(rich, keys, "left_semi").unionByName(cells.join(rich, keys, "left_anti"))


def headline_dsr(summaries: DataFrame, ts: DataFrame, ids: list[str], arm: str, metric: str, ret: str = "net20",
                 horizon: str = "horizon") -> DataFrame:
    """Deflated Sharpe of the best cell against the trials of its own arm, from the 20 bps series."""
    best = best_cell(summaries, metric, ids).select(*ids, F.col(metric).alias("winning_sharpe"))
    won = ts.join(best.select(*ids), ids, "left_semi").where(F.col("row_idx") % F.col(horizon) == 0)
    pool = trial_pool(summaries, [arm], sharpe=metric).withColumnRenamed("sharpe", "trial_sharpe")
    out = deflated_sharpe(won.where(F.col(ret).isNotNull()), pool, ids, [arm], horizon, ret, "trial_sharpe")
    return out.join(best, ids)
