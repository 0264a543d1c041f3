"""From a panel of predictions to one summary per cell: sweep, best size, costs, long-only books, rank IC, coverage, trust in intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators import metrics as mt
from barweave.operators import portfolio as pf
from barweave.operators.inference import CI_TIERS, ci_tier, ic_series, ic_summary, rank_ic
from barweave.operators.report import cost_map
from barweave.session import cut_lineage, stored

COST_METRICS = ["net_sharpe", "net_mdd", "net_cumulative_return", "net_n_obs_nonoverlap", "avg_turnover_per_rebalance"]
LONG_SIZE, LONG_BPS = 30, 20.0


def cost_rows(ts: DataFrame, keys: list[str], horizon: str = "horizon") -> DataFrame:
    """``COST_METRICS`` per (keys, top_n, cost_bps) on the rebalance rows; idle rows count in the mean turnover only."""
    series = [*keys, "top_n", "cost_bps"]
    path = mt.drawdown_path(pf.non_overlap(ts, horizon), series)
    return path.groupBy(*series).agg(
        mt.sharpe("net", horizon).alias("net_sharpe"), (1.0 - F.exp(-F.max(F.col("log_peak") - F.col("log_equity")))).alias("net_mdd"),
        mt.cumulative_return("net").alias("net_cumulative_return"), F.count("net").cast("double").alias("net_n_obs_nonoverlap"),
        F.avg("turnover").alias("avg_turnover_per_rebalance"))


def size_sweep(ts: DataFrame, keys: list[str], horizon: str = "horizon") -> DataFrame:
    """Gross Sharpe and number of observations per (keys, top_n) on the rebalance rows: val_sharpe, val_n_obs."""
    return pf.non_overlap(ts, horizon).groupBy(*keys, "top_n").agg(mt.sharpe("gross", horizon).alias("val_sharpe"), F.count("gross").alias("val_n_obs"))


def evaluate_cells(panel: DataFrame, keys: list[str], sizes: list[int] = pf.TOP_N_GRID, bps: list[float] = pf.BPS_GRID, long_size: int = LONG_SIZE,
                   long_bps: float = LONG_BPS, tiers: dict[int, str] = CI_TIERS, horizon: str = "horizon", split: str = "split") -> DataFrame:
    """One row per cell of ``keys`` (``horizon`` among them) that has test rows.

    The book size with the best gross Sharpe on the rows of ``split`` "val" is ``best_top_n``; ``sweep_topn`` lists all sizes.
    On the "test" rows: ``cost_sensitivity`` maps every cost to the metrics of that size; ``longonly_appendix`` those of long-only books of
    that size ("best") and of ``long_size`` names, at ``long_bps``; ``ic_mean`` and ``ic_std`` of the Spearman IC on the rebalance rows;
    ``n_test_timestamps`` with a prediction, ``inference_valid``, and ``ci_tier`` of the horizon. The panel is made once and
    stored, since every part reads it. It is ranked once for all sizes and costs of
    both splits, and once more for the long-only books; what is joined afterwards has one row per cell and size.
    """
    panel = stored(panel, "panel")
    books = cut_lineage(pf.backtest(panel, [split, *keys], sizes, bps=bps))
    of = lambda part: books.where(F.col(split) == part).drop(split)
    swept = size_sweep(of("val").where(F.col("cost_bps") == bps[0]), keys, horizon)
    entry = F.struct(F.col("top_n").cast("int").alias("top_n"), F.col("val_sharpe").alias("val_sharpe_gross"), F.col("val_n_obs").cast("long").alias("val_n_obs"))
    chosen = pf.select_topn(swept, keys, sizes, "val_sharpe").withColumnRenamed("top_n", "best_top_n").join(
        swept.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("sweep_topn")), keys)

    test = panel.where(F.col(split) == "test").drop(split)
    costs = cost_rows(of("test"), keys, horizon).join(chosen.select(*keys, "best_top_n"), keys).where(F.col("top_n") == F.col("best_top_n"))
    long_rows = cost_rows(pf.backtest(test, keys, [*sizes, long_size], "long_only", [long_bps]), keys, horizon)
    long_rows = long_rows.join(chosen.select(*keys, "best_top_n"), keys)
    named = F.array_compact(F.array(F.when(F.col("top_n") == F.col("best_top_n"), F.lit("best")), F.when(F.col("top_n") == long_size, F.lit(str(long_size)))))
    appendix = cost_map(long_rows.withColumn("book", F.explode(named)), keys, COST_METRICS, "book").withColumnRenamed("cost_sensitivity", "longonly_appendix")

    ic = ic_summary(ic_series(test, rank_ic(test, keys), pf.panel_rows(test, keys), keys), keys, horizon).select(*keys, "ic_mean", "ic_std")
    seen = mt.panel_coverage(test, keys).withColumnRenamed("n_timestamps", "n_test_timestamps")
    out = seen.join(chosen, keys, "left").join(cost_map(costs, keys, COST_METRICS), keys, "left")
    return out.join(appendix, keys, "left").join(ic, keys, "left").withColumn("ci_tier", ci_tier(horizon, tiers))
