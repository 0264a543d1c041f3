"""Queries: signals, positions, costs, performance and error metrics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.operators import features as ft
from barweave.operators import evaluate as ev
from barweave.operators import metrics as mt
from barweave.operators import portfolio as pf
from barweave.operators import report as rp
from barweave.operators import signals as sg
from barweave.operators.bootstrap import pair_arms
from barweave.operators.inference import ci_tier
from barweave.plans.fixtures import (
    BARS, CELL, FOLD_ROWS, FOLDS, HORIZONS, LENGTH, PANEL, PANEL_CTES, SAMPLES, SCALER, SIGNAL_CTES, SIGNALS, VAL, VAL_CTES,
    bars, signals, table, test_panel, val_panel,
)
from barweave.plans.registry import query
from barweave.plans.rolling import VOL, W, sql_corr
from barweave.session import stored

GRID = pf.TOP_N_GRID
BPS = pf.BPS_GRID
CELLS = "strategy, horizon, fold"
CELL_SPEC = "strategy:s horizon:i fold:s"


def grid_sql(values: list) -> str:
    return "(VALUES " + ", ".join(f"({v})" for v in values) + ")"


RANKED = f"""ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {CELLS}, date ORDER BY pred, entity) AS rank_low,
    row_number() OVER (PARTITION BY {CELLS}, date ORDER BY pred DESC, entity DESC) AS rank_high,
    count(*) OVER (PARTITION BY {CELLS}, date) AS n_valid FROM panel WHERE pred IS NOT NULL)"""


def held_sql(sizes: list[int], mode: str = "long_short", source: str = "ranked") -> str:
    long, short = "rank_high <= n", "rank_low <= n"
    hit = {"long_short": f"({long} OR {short})", "long_only": long, "short_only": short}[mode]
    return (f"SELECT {CELLS}, n AS top_n, date, entity, actual, pred, CASE WHEN {long} THEN 1.0::DOUBLE / n ELSE -1.0::DOUBLE / n END AS weight "
            f"FROM {source}, {grid_sql(sizes)} g(n) WHERE n_valid >= 2 * n AND {hit}")


def pos_sql(sizes: list[int], mode: str = "long_short") -> str:
    return f"sizes AS (SELECT * FROM {grid_sql(sizes)} s(top_n)), pos AS MATERIALIZED ({held_sql(sizes, mode)})"


POS = pos_sql(GRID)
ROWS = f"""prow AS MATERIALIZED (SELECT {CELLS}, date, row_number() OVER (PARTITION BY {CELLS} ORDER BY date) - 1 AS row_idx
  FROM (SELECT DISTINCT {CELLS}, date FROM panel) d)"""


def port_sql(basis: int | str = 1) -> str:
    on = "a.strategy = b.strategy AND a.horizon = b.horizon AND a.fold = b.fold AND a.top_n = b.top_n AND a.entity = b.entity"
    return f"""placed AS MATERIALIZED (SELECT p.*, row_idx FROM pos p JOIN prow r USING (strategy, horizon, fold, date)),
traded AS (
  SELECT coalesce(a.strategy, b.strategy) AS strategy, coalesce(a.horizon, b.horizon) AS horizon, coalesce(a.fold, b.fold) AS fold,
    coalesce(a.top_n, b.top_n) AS top_n, coalesce(a.row_idx, b.row_idx + {basis}) AS row_idx,
    sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover, sum(coalesce(a.weight * a.actual, 0)) AS gross, count(a.weight) AS n_held
  FROM placed a FULL JOIN placed b ON {on} AND a.row_idx = b.row_idx + {basis} GROUP BY 1, 2, 3, 4, 5),
port AS MATERIALIZED (
  SELECT strategy, horizon, fold, top_n, date, row_idx, coalesce(n_held, 0) AS n_held, CASE WHEN coalesce(n_held, 0) > 0 OR coalesce(turnover, 0) > 0 THEN coalesce(turnover, 0) ELSE 0 END AS turnover,
    CASE WHEN coalesce(n_held, 0) > 0 OR coalesce(turnover, 0) > 0 THEN coalesce(gross, 0) END AS gross
  FROM (SELECT r.*, s.top_n FROM prow r, sizes s) g
  LEFT JOIN traded USING (strategy, horizon, fold, top_n, row_idx))"""


PORT = port_sql()
PORT_CTES = [*PANEL_CTES, RANKED, POS, ROWS, PORT]
VAL_PORT_CTES = [*VAL_CTES, RANKED, POS, ROWS, PORT]


def sharpe_sql(r: str, h: str = "horizon") -> str:
    return f"CASE WHEN count({r}) >= 2 AND stddev_samp({r}) >= 1e-12 THEN avg({r}) / stddev_samp({r}) * sqrt(252.0 / {h}) END"


def clipped(r: str) -> str:
    return f"CASE WHEN {r} IS NOT NULL THEN ln(1 + greatest({r}, -0.99)) END"


def portfolio(panel: DataFrame, sizes=GRID, mode: str = "long_short", bps=[20.0], **options) -> DataFrame:
    return pf.backtest(panel, CELL, sizes, mode, bps, **options)


# ---- model-style predictions ----------------------------------------------------------

PREDICTED = f"""predicted AS (
  SELECT entity, date, mu, log_sigma2, 0.5 * log_sigma2 AS log_vol, CASE WHEN log_sigma2 IS NOT NULL THEN exp(0.5 * greatest(-12.0, least(4.0, log_sigma2))) END AS sigma FROM (
    SELECT entity, date, -(close - lag(close, 4) OVER w) / 100000.0 AS mu,
      CASE WHEN count(r) OVER w20 = 20 THEN ln(var_pop(r) OVER w20 + 1e-6) END AS log_sigma2
    FROM (SELECT *, ln(close / lag(close) OVER ({W})) AS r FROM bars) b
    WINDOW w AS ({W}), w20 AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) q)"""


def predictions(spark, sf_dir) -> DataFrame:
    w = ft.by_entity()
    mu = -(F.col("close") - F.lag("close", 4).over(w)) / 100000.0
    out = sg.prediction_table(bars(spark, sf_dir), mu).select("entity", "date", "mu", "log_sigma2", "log_vol")
    return out.withColumn("sigma", F.when(F.col("log_sigma2").isNotNull(), sg.sigma_of()))


def gate_sql(t: float, tv: str = "0.0", ts: str = "0.0") -> str:
    return f"(1 / (1 + exp(-(({tv} - log_vol) / {t})))) * (1 / (1 + exp(-(({ts} - sigma) / {t}))))"


@query("confidence_gate", "entity:i date:d sigma:f gate:f gate_hot:f",
       f"SELECT entity, date, sigma, {gate_sql(0.13, '1.0', '2.0')} AS gate, {gate_sql(1.0)} AS gate_hot FROM predicted WHERE log_sigma2 IS NOT NULL",
       [BARS, PREDICTED])
def confidence_gate(spark, sf_dir):
    known = predictions(spark, sf_dir).where(F.col("log_sigma2").isNotNull())
    return known.withColumns({"gate": sg.gate(tau_vol=1.0, tau_sigma=2.0), "gate_hot": sg.gate(temperature=1.0)})


@query("tanh_position", "entity:i date:d trained:f inferred:f",
       "SELECT entity, date, tanh(10 * mu / (sigma + 1e-3)) AS trained, tanh(5 * mu / greatest(sigma, 1e-3)) AS inferred FROM predicted WHERE mu IS NOT NULL AND sigma IS NOT NULL",
       [BARS, PREDICTED])
def tanh_position(spark, sf_dir):
    known = predictions(spark, sf_dir).where(F.col("mu").isNotNull() & F.col("sigma").isNotNull())
    return known.withColumns({"trained": sg.position("mu", "sigma", 10.0), "inferred": sg.position("mu", "sigma", 5.0, inference=True)})


@query("price_to_return", "entity:i date:d pred_return:f actual_return:f",
       f"""SELECT entity, date, (pn - close) / greatest(close, 1e-9) AS pred_return, (nx - close) / greatest(close, 1e-9) AS actual_return FROM (
  SELECT entity, date, close, lead(close) OVER w AS nx, lag(close) OVER w AS pn FROM bars WINDOW w AS ({W})) q WHERE nx IS NOT NULL AND pn IS NOT NULL""",
       [BARS])
def price_to_return(spark, sf_dir):
    w, own = ft.by_entity(), Window.partitionBy("entity")
    b = bars(spark, sf_dir).withColumns({"lo": F.min("close").over(own), "hi": F.max("close").over(own)})
    mm = (F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    b = b.withColumn("last", mm).withColumns({"truth": F.lead("last").over(w), "guess": F.lag("last").over(w)}).dropna(subset=["truth", "guess"])
    return sg.to_returns(b, "guess", "truth", "last", "lo", "hi")


# ---- signals ---------------------------------------------------------------------------

def signal_query(name: str, strategy: str, expr: str) -> None:
    @query(name, "entity:i date:d signal:f",
           f"""SELECT entity, date, {expr} AS signal FROM (SELECT entity, date, z, zv, lag(z, 20) OVER w AS zn, lag(z, 51) OVER w AS zf, lag(z, 4) OVER w AS z5,
  lag(z, 1) OVER w AS z1 FROM (SELECT entity, date, (close - avg(close) OVER p) / stddev_pop(close) OVER p AS z, (volume - avg(volume) OVER p) / stddev_pop(volume) OVER p AS zv
  FROM bars WINDOW p AS (PARTITION BY entity)) b WINDOW w AS ({W})) q""", [BARS])
    def run(spark, sf_dir):
        own = Window.partitionBy("entity")
        z = lambda c: (F.col(c) - F.avg(c).over(own)) / F.stddev_pop(c).over(own)
        scored = bars(spark, sf_dir).select("entity", "date", z("close").alias("z"), z("volume").alias("zv"))
        return sg.signal(scored, strategy, LENGTH, "zv", close="z")


signal_query("xs_momentum", "xs_momentum", "zn - zf")
signal_query("xs_reversal", "xs_reversal", "-(z - z5)")
signal_query("ridge_alpha", "ridge_alpha", "(zn - zf) - 0.3 * (z - z1) + 0.5 * (z - zf) + 0.2 * zv")


@query("collect_signals", f"{CELL_SPEC} split:s date:d entity:i pred:f actual:f", "SELECT * FROM signals", SIGNAL_CTES)
def collect_signals(spark, sf_dir):
    return signals(spark, sf_dir)


# ---- ranks and positions ---------------------------------------------------------------

@query("cross_section_rank", f"{CELL_SPEC} date:d entity:i rank_low:i rank_high:i n_valid:i",
       "SELECT * FROM ranked WHERE rank_low <= 15 OR rank_high <= 15", [*PANEL_CTES, RANKED])
def cross_section_rank(spark, sf_dir):
    return pf.cross_section_rank(test_panel(spark, sf_dir), CELL, 15)


@query("long_short", f"{CELL_SPEC} top_n:i date:d entity:i weight:f", "SELECT * FROM pos", [*PANEL_CTES, RANKED, POS])
def long_short(spark, sf_dir):
    return pf.positions(test_panel(spark, sf_dir), CELL)


@query("short_only", f"{CELL_SPEC} top_n:i date:d entity:i weight:f", "SELECT * FROM pos", [*PANEL_CTES, RANKED, pos_sql(GRID, "short_only")])
def short_only(spark, sf_dir):
    return pf.positions(test_panel(spark, sf_dir), CELL, mode="short_only")


FILTERED = RANKED.replace("FROM panel WHERE pred IS NOT NULL", "FROM panel WHERE abs(pred) > 0.5")


@query("magnitude_filter", f"{CELL_SPEC} top_n:i date:d entity:i weight:f", held_sql([3, 10]), [*PANEL_CTES, FILTERED])
def magnitude_filter(spark, sf_dir):
    return pf.positions(test_panel(spark, sf_dir), CELL, [3, 10], min_abs=0.5)


def with_vol(spark, sf_dir) -> DataFrame:
    vol = ft.realized_vol(bars(spark, sf_dir), out="vol").select("entity", "date", "vol")
    return test_panel(spark, sf_dir).join(vol, ["entity", "date"])


@query("inv_vol_weights", f"{CELL_SPEC} top_n:i date:d entity:i weight:f",
       f"""SELECT {CELLS}, top_n, date, entity, side * (1 / greatest(realized_vol, 1e-6)) / sum(1 / greatest(realized_vol, 1e-6)) OVER (PARTITION BY {CELLS}, top_n, date, side) AS weight
  FROM (SELECT p.*, sign(weight) AS side, realized_vol FROM ({held_sql([5])}) p JOIN vols USING (entity, date)) q""", [*PANEL_CTES, RANKED, VOL])
def inv_vol_weights(spark, sf_dir):
    return pf.positions(with_vol(spark, sf_dir), CELL, [5], weighting="inv_vol")


RISK_PANEL = f"""riskp AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY horizon, date ORDER BY score, entity) AS rank_low, row_number() OVER (PARTITION BY horizon, date ORDER BY score DESC, entity DESC) AS rank_high,
    count(*) OVER (PARTITION BY horizon, date) AS n_valid FROM (
    SELECT horizon, date, entity, mu, sigma, y_logret AS actual, {gate_sql(0.13, '1.0', '2.0')} AS gate, mu / greatest(sigma, 1e-3) AS score
    FROM predicted JOIN samp USING (entity, date) WHERE predicted.mu IS NOT NULL AND sigma IS NOT NULL) g WHERE gate >= 0.001)"""


def risk_panel(spark, sf_dir) -> DataFrame:
    from barweave.operators.splits import sample_index
    y = sample_index(bars(spark, sf_dir), LENGTH, HORIZONS).select("entity", "date", "horizon", F.col("y_logret").alias("actual"))
    p = predictions(spark, sf_dir).where(F.col("mu").isNotNull() & F.col("sigma").isNotNull())
    return p.withColumn("gate", sg.gate(tau_vol=1.0, tau_sigma=2.0)).join(y, ["entity", "date"])


@query("risk_aware_weights", "horizon:i top_n:i date:d entity:i weight:f",
       """SELECT horizon, 5 AS top_n, date, entity, side * raw / s AS weight FROM (SELECT *, sum(raw) OVER (PARTITION BY horizon, date, side) AS s FROM (
  SELECT *, CASE WHEN rank_high <= 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side, abs(tanh(5.0 * score)) * gate AS raw FROM riskp
  WHERE n_valid >= 10 AND (rank_high <= 5 OR rank_low <= 5)) a) b WHERE s > 1e-9""", [BARS, FOLD_ROWS, SAMPLES, PREDICTED, RISK_PANEL])
def risk_aware_weights(spark, sf_dir):
    return pf.positions(risk_panel(spark, sf_dir), ["horizon"], [5], weighting="risk_aware", signal="mu", gate_min=0.001)


# ---- returns ------------------------------------------------------------------------------

@query("turnover", f"{CELL_SPEC} top_n:i date:d row_idx:i turnover:f",
       "SELECT * FROM port WHERE n_held > 0 OR turnover > 0", PORT_CTES)
def turnover(spark, sf_dir):
    panel = test_panel(spark, sf_dir)
    return pf.turnover(pf.positions(panel, CELL), pf.panel_rows(panel, CELL), CELL)


@query("portfolio_returns", f"{CELL_SPEC} top_n:i date:d row_idx:i gross:f turnover:f net:f",
       "SELECT *, gross - 20.0 / 10000.0 * turnover AS net FROM port", PORT_CTES)
def portfolio_returns(spark, sf_dir):
    return portfolio(test_panel(spark, sf_dir))


@query("portfolio_returns_rebalanced", f"{CELL_SPEC} top_n:i date:d row_idx:i gross:f turnover:f net:f",
       "SELECT *, gross - 20.0 / 10000.0 * turnover AS net FROM port", [*PANEL_CTES, RANKED, POS, ROWS, port_sql("b.horizon")])
def portfolio_returns_rebalanced(spark, sf_dir):
    return portfolio(test_panel(spark, sf_dir), basis=F.col("horizon"))


#: The larger book needs 84 names, which some dates have and others have not: it goes flat and comes back.
WIDE = [5, 42]
WIDE_CTES = [*PANEL_CTES, RANKED, pos_sql(WIDE), ROWS, PORT]


@query("portfolio_returns_legacy", f"{CELL_SPEC} top_n:i date:d row_idx:i gross:f turnover:f net:f",
       """SELECT strategy, horizon, fold, top_n, date, row_idx, CASE WHEN n_held > 0 THEN gross END AS gross, CASE WHEN n_held > 0 THEN turnover ELSE 0 END AS turnover,
  CASE WHEN n_held > 0 THEN gross - 20.0 / 10000.0 * turnover END AS net FROM port""", WIDE_CTES)
def portfolio_returns_legacy(spark, sf_dir):
    return portfolio(test_panel(spark, sf_dir), WIDE, charge_unwind=False)


@query("non_overlap_sample", f"{CELL_SPEC} top_n:i row_idx:i gross:f",
       "SELECT * FROM port WHERE row_idx % horizon = 0", WIDE_CTES)
def non_overlap_sample(spark, sf_dir):
    return pf.non_overlap(portfolio(test_panel(spark, sf_dir), WIDE))


# ---- metric block ---------------------------------------------------------------------------

NET = "net AS MATERIALIZED (SELECT *, gross - 20.0 / 10000.0 * turnover AS net FROM port WHERE row_idx % horizon = 0)"
SERIES = [*CELL, "top_n"]
SERIES_SPEC = f"{CELL_SPEC} top_n:i"
BY_SERIES = f"{CELLS}, top_n"
MDD = f"""dd AS (SELECT {BY_SERIES}, 1 - exp(-max(pk - lg)) AS mdd FROM (
  SELECT *, max(lg) OVER (PARTITION BY {BY_SERIES} ORDER BY row_idx) AS pk FROM (
    SELECT *, sum({clipped('net')}) OVER (PARTITION BY {BY_SERIES} ORDER BY row_idx) AS lg FROM net WHERE net IS NOT NULL) a) b GROUP BY {BY_SERIES})"""
ANNUAL = "pow(1 + avg(net), 252.0 / horizon) - 1"
BLOCK = f"""block AS (
  SELECT *, CASE WHEN mdd >= 1e-9 THEN annualized_return / mdd END AS calmar, n_obs >= 6 AS inference_valid FROM (
    SELECT {BY_SERIES}, count(net) AS n_obs, {sharpe_sql('net')} AS sharpe,
      CASE WHEN count(net) < 2 THEN NULL WHEN count(*) FILTER (net < 0) = 0 THEN 'inf'::DOUBLE
        WHEN sqrt(avg(net * net) FILTER (net < 0)) >= 1e-12 THEN avg(net) / sqrt(avg(net * net) FILTER (net < 0)) * sqrt(252.0 / horizon) END AS sortino,
      exp(sum({clipped('net')})) - 1 AS cumulative_return, CASE WHEN 1 + avg(net) > 0 THEN {ANNUAL} END AS annualized_return,
      avg(CASE WHEN net > 0 THEN 1.0::DOUBLE WHEN net IS NOT NULL THEN 0 END) AS hit_rate
    FROM net GROUP BY {BY_SERIES}) m LEFT JOIN dd USING ({BY_SERIES}))"""
BLOCK_CTES = [*PORT_CTES, NET, MDD, BLOCK]


def net_series(spark, sf_dir) -> DataFrame:
    return pf.non_overlap(portfolio(test_panel(spark, sf_dir)))


def metric_block(spark, sf_dir) -> DataFrame:
    return mt.perf_metrics(net_series(spark, sf_dir), SERIES)


def register_metric(name: str, columns: str) -> None:
    @query(name, f"{SERIES_SPEC} {columns}", "SELECT * FROM block", BLOCK_CTES)
    def run(spark, sf_dir):
        return metric_block(spark, sf_dir)


for metric, kind in [("sharpe", "f"), ("sortino", "f"), ("cumulative_return", "g"), ("annualized_return", "g"), ("calmar", "g"),
                     ("hit_rate", "f")]:
    register_metric(metric, f"{metric}:{kind}")
register_metric("max_drawdown", "mdd:f")
register_metric("metric_block", "n_obs:i sharpe:f sortino:f cumulative_return:g annualized_return:g mdd:f calmar:g hit_rate:f inference_valid:b")


COSTED = f"""costed AS (
  SELECT {BY_SERIES}, row_idx, cost_bps, turnover, gross - cost_bps / 10000.0 * turnover AS net FROM port, {grid_sql([f'{b}::DOUBLE' for b in BPS])} c(cost_bps) WHERE row_idx % horizon = 0)"""
COST_TABLE = f"""cost_table AS (
  SELECT {BY_SERIES}, cost_bps, {sharpe_sql('net')} AS net_sharpe, exp(sum({clipped('net')})) - 1 AS net_cumulative_return,
    CAST(count(net) AS DOUBLE) AS net_n_obs_nonoverlap, avg(turnover) AS avg_turnover_per_rebalance FROM costed GROUP BY {BY_SERIES}, cost_bps)"""


def cost_table(panel: DataFrame, sizes=GRID, mode: str = "long_short") -> DataFrame:
    return cost_rows(portfolio(panel, sizes, mode, BPS))


def cost_rows(ts: DataFrame) -> DataFrame:
    return ev.cost_rows(ts, CELL)


@query("cost_sweep", f"{SERIES_SPEC} cost_bps:f net_sharpe:f net_cumulative_return:g net_n_obs_nonoverlap:f avg_turnover_per_rebalance:f",
       "SELECT * FROM cost_table", [*PORT_CTES, COSTED, COST_TABLE])
def cost_sweep(spark, sf_dir):
    return cost_table(test_panel(spark, sf_dir))


SWEPT = f"""swept AS (SELECT {BY_SERIES}, {sharpe_sql('gross')} AS val_sharpe, count(gross) AS val_n_obs FROM port WHERE row_idx % horizon = 0 GROUP BY {BY_SERIES})"""
BEST = f"""best AS (SELECT {CELLS}, coalesce(arg_max(top_n, row(val_sharpe, -top_n)) FILTER (val_sharpe IS NOT NULL), 7) AS top_n FROM swept GROUP BY {CELLS})"""


def sweep(panel: DataFrame) -> DataFrame:
    return ev.size_sweep(portfolio(panel, bps=[0.0]), CELL)


@query("topn_sweep", f"{SERIES_SPEC} val_sharpe:f val_n_obs:i", "SELECT * FROM swept", [*VAL_PORT_CTES, SWEPT])
def topn_sweep(spark, sf_dir):
    return sweep(val_panel(spark, sf_dir))


@query("argmax_topn", f"{SERIES_SPEC}", "SELECT * FROM best", [*VAL_PORT_CTES, SWEPT, BEST])
def argmax_topn(spark, sf_dir):
    return pf.select_topn(sweep(val_panel(spark, sf_dir)), CELL, GRID, "val_sharpe")


LONG_POS = pos_sql([*GRID, 30], "long_only")
#: The validation sweep beside the test panel: the same steps under other names.
VAL_SIDE = [re.sub(r"\b(panel|ranked|sizes|pos|prow|placed|traded|port|swept|best)\b", r"val_\1", c) for c in [VAL, RANKED, POS, ROWS, PORT, SWEPT, BEST]]


@query("long_only_appendix", f"{SERIES_SPEC} cost_bps:f net_sharpe:f net_cumulative_return:g",
       "SELECT c.* FROM cost_table c WHERE top_n = 30 OR EXISTS (SELECT 1 FROM val_best b WHERE b.strategy = c.strategy AND b.horizon = c.horizon AND b.fold = c.fold AND b.top_n = c.top_n)",
       [*SIGNAL_CTES, *VAL_SIDE, PANEL, RANKED, LONG_POS, ROWS, PORT, COSTED, COST_TABLE])
def long_only_appendix(spark, sf_dir):
    """Long-only books of the size that won on validation, and of 30 names."""
    best = argmax_topn(spark, sf_dir)
    table_ = cost_table(test_panel(spark, sf_dir), [*GRID, 30], "long_only")
    return table_.where(F.col("top_n") == 30).unionByName(table_.where(F.col("top_n") != 30).join(best, [*CELL, "top_n"], "left_semi"))


VOLZ = f"""volz AS (SELECT entity, date, CASE WHEN row_number() OVER ({W}) > 40 THEN (realized_vol - avg(realized_vol) OVER p) / (stddev_samp(realized_vol) OVER p + 1e-12) END AS vol_z
  FROM vols WINDOW p AS ({W} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING))"""


@query("vol_kill_switch", f"{SERIES_SPEC} row_idx:i port_z:f killed:b gross_gated:f",
       f"""SELECT {BY_SERIES}, row_idx, port_z, coalesce(port_z > 0.5, false) AS killed, CASE WHEN port_z > 0.5 THEN 0 ELSE gross END AS gross_gated FROM port LEFT JOIN (
  SELECT {BY_SERIES}, date, avg(vol_z) AS port_z FROM pos JOIN volz USING (entity, date) GROUP BY {BY_SERIES}, date) z USING ({BY_SERIES}, date)""",
       [*PORT_CTES, VOL, VOLZ])
def vol_kill_switch(spark, sf_dir):
    panel = stored(test_panel(spark, sf_dir), "panel")
    pos = stored(pf.positions(panel, CELL), "positions")
    ts = pf.portfolio_returns(pos, pf.panel_rows(panel, CELL), CELL, GRID)
    z = ft.vol_zscore(ft.realized_vol(bars(spark, sf_dir))).select("entity", "date", "vol_z")
    return pf.vol_gate(ts, pos.join(z, ["entity", "date"]), SERIES, 0.5)


EXPORT_POS = pos_sql([10])


def timeseries(panel: DataFrame, n: int = 10, bps: float = 20.0, long_n: int = 30) -> DataFrame:
    """Daily and every-H-th-row series of the long-short and the long-only book, gross and net."""
    def book(size: int, mode: str, prefix: str) -> DataFrame:
        ts = portfolio(panel, [size], mode, [bps])
        on = F.col("row_idx") % F.col("horizon") == 0
        return ts.select(*CELL, "date", "row_idx", F.col("gross").alias(f"{prefix}_gross_daily"), F.col("net").alias(f"{prefix}_net_daily"),
                         F.when(on, F.col("gross")).alias(f"{prefix}_gross_nonoverlap"), F.when(on, F.col("net")).alias(f"{prefix}_net_nonoverlap"))

    return book(n, "long_short", "ls").join(book(long_n, "long_only", "lo"), [*CELL, "date", "row_idx"])


LS_LONG = f"""lo_pos AS MATERIALIZED ({held_sql([30], 'long_only')}),
lo_placed AS (SELECT p.*, row_idx FROM lo_pos p JOIN prow r USING (strategy, horizon, fold, date)),
lo AS (SELECT coalesce(a.strategy, b.strategy) AS strategy, coalesce(a.horizon, b.horizon) AS horizon, coalesce(a.fold, b.fold) AS fold, coalesce(a.row_idx, b.row_idx + 1) AS row_idx,
  sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS lo_turn, sum(coalesce(a.weight * a.actual, 0)) AS lo_gross
  FROM lo_placed a FULL JOIN lo_placed b ON a.strategy = b.strategy AND a.horizon = b.horizon AND a.fold = b.fold AND a.entity = b.entity AND a.row_idx = b.row_idx + 1 GROUP BY 1, 2, 3, 4)"""


@query("timeseries_export",
       f"{CELL_SPEC} date:d row_idx:i ls_gross_daily:f ls_net_daily:f ls_gross_nonoverlap:f ls_net_nonoverlap:f lo_gross_daily:f lo_net_daily:f lo_gross_nonoverlap:f lo_net_nonoverlap:f",
       f"""SELECT {CELLS}, date, row_idx, ls_g AS ls_gross_daily, ls_n AS ls_net_daily, CASE WHEN row_idx % horizon = 0 THEN ls_g END AS ls_gross_nonoverlap,
  CASE WHEN row_idx % horizon = 0 THEN ls_n END AS ls_net_nonoverlap, lo_g AS lo_gross_daily, lo_n AS lo_net_daily,
  CASE WHEN row_idx % horizon = 0 THEN lo_g END AS lo_gross_nonoverlap, CASE WHEN row_idx % horizon = 0 THEN lo_n END AS lo_net_nonoverlap FROM (
  SELECT r.*, p.gross AS ls_g, p.gross - 20.0 / 10000.0 * p.turnover AS ls_n, lo_gross AS lo_g, lo_gross - 20.0 / 10000.0 * lo_turn AS lo_n
  FROM prow r LEFT JOIN port p USING (strategy, horizon, fold, date, row_idx) LEFT JOIN lo USING (strategy, horizon, fold, row_idx)) q""",
       [*PANEL_CTES, RANKED, EXPORT_POS, ROWS, PORT, LS_LONG])
def timeseries_export(spark, sf_dir):
    return timeseries(test_panel(spark, sf_dir))


# ---- panel metrics ------------------------------------------------------------------------

@query("regression_metrics", f"{CELL_SPEC} n:i mse:f mae:f rmse:f r2:f mape:g mspe:g rrse:f corr:f",
       f"""SELECT *, sqrt(mse) AS rmse, 1 - mse / v AS r2, sqrt(mse / v) AS rrse FROM (
  SELECT {CELLS}, count(*) AS n, avg(pow(actual - pred, 2)) AS mse, avg(abs(actual - pred)) AS mae, avg(abs((actual - pred) / nullif(actual, 0))) AS mape,
    avg(pow((actual - pred) / nullif(actual, 0), 2)) AS mspe, var_pop(actual) AS v, sum((actual - ma) * (pred - mp)) / sqrt(sum(pow((actual - ma) * (pred - mp), 2))) AS corr
  FROM (SELECT *, avg(actual) OVER (PARTITION BY {CELLS}) AS ma, avg(pred) OVER (PARTITION BY {CELLS}) AS mp FROM panel WHERE pred IS NOT NULL) p GROUP BY {CELLS}) q""", PANEL_CTES)
def regression_metrics(spark, sf_dir):
    return mt.regression_metrics(test_panel(spark, sf_dir), CELL)


@query("usd_metrics", "fold:s n:i mse:g mae:g r2:f corr:f",
       f"""SELECT *, 1 - mse / v AS r2 FROM (SELECT fold, count(*) AS n, avg(pow(nx - close, 2)) AS mse, avg(abs(nx - close)) AS mae, var_pop(nx) AS v,
  sum((nx - ma) * (close - mp)) / sqrt(sum(pow((nx - ma) * (close - mp), 2))) AS corr FROM (
    SELECT *, avg(nx) OVER (PARTITION BY fold) AS ma, avg(close) OVER (PARTITION BY fold) AS mp FROM (
      SELECT year(date)::VARCHAR AS fold, close, lead(close) OVER ({W}) AS nx FROM bars) a WHERE nx IS NOT NULL) b GROUP BY 1) c""", [BARS])
def usd_metrics(spark, sf_dir):
    from barweave.operators.splits import apply_minmax, fit_minmax
    b = bars(spark, sf_dir)
    fit = fit_minmax(b, ["close"])
    scaled = apply_minmax(b, fit, ["close"]).withColumn("truth", F.lead("mm_close").over(ft.by_entity())).drop("lo_close", "hi_close")
    rows = scaled.where(F.col("truth").isNotNull()).withColumn("fold", F.year("date").cast("string"))
    return mt.usd_metrics(rows, fit, ["fold"], "mm_close", "truth", "lo_close", "hi_close")


@query("accuracy", f"{CELL_SPEC} accuracy:f", f"SELECT {CELLS}, avg(CASE WHEN sign(pred) = sign(actual) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM panel WHERE pred IS NOT NULL GROUP BY {CELLS}",
       PANEL_CTES)
def accuracy(spark, sf_dir):
    p = test_panel(spark, sf_dir).where(F.col("pred").isNotNull()).withColumns({"guess": F.signum("pred"), "truth": F.signum("actual")})
    return mt.accuracy(p, "guess", "truth", CELL)


@query("naive_equal_weight", f"{CELL_SPEC} date:d naive_return:f", f"SELECT {CELLS}, date, avg(actual) AS naive_return FROM panel GROUP BY {CELLS}, date", PANEL_CTES)
def naive_equal_weight(spark, sf_dir):
    return mt.naive_equal_weight(test_panel(spark, sf_dir), CELL)


@query("pointwise_sharpe_median", f"{CELL_SPEC} n_entities:i median_sharpe:f",
       f"""SELECT {CELLS}, count(s) AS n_entities, quantile_cont(s, 0.5) AS median_sharpe FROM (
  SELECT {CELLS}, entity, {sharpe_sql('r')} AS s FROM (
    SELECT *, sign(pred) * actual AS r, row_number() OVER (PARTITION BY {CELLS}, entity ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY {CELLS}, entity) AS n
    FROM panel WHERE pred IS NOT NULL) a WHERE n >= 30 AND i % horizon = 0 GROUP BY {CELLS}, entity) b WHERE s IS NOT NULL GROUP BY {CELLS}""", PANEL_CTES)
def pointwise_sharpe_median(spark, sf_dir):
    return mt.pointwise_sharpe(test_panel(spark, sf_dir), CELL)


@query("panel_coverage", f"{CELL_SPEC} n_timestamps:i inference_valid:b",
       f"SELECT {CELLS}, count(DISTINCT CASE WHEN pred IS NOT NULL THEN date END) AS n_timestamps, count(DISTINCT CASE WHEN pred IS NOT NULL THEN date END) >= 6 AS inference_valid FROM panel GROUP BY {CELLS}",
       PANEL_CTES)
def panel_coverage(spark, sf_dir):
    return mt.panel_coverage(test_panel(spark, sf_dir), CELL)


@query("ci_tier", f"{CELL_SPEC} tier:s", f"SELECT DISTINCT {CELLS}, CASE horizon WHEN 1 THEN 'full' WHEN 2 THEN 'aggregate' ELSE 'unknown' END AS tier FROM panel", PANEL_CTES)
def ci_tier_query(spark, sf_dir):
    return test_panel(spark, sf_dir).select(*CELL).distinct().withColumn("tier", ci_tier("horizon", {1: "full", 2: "aggregate"}))


SIGMA_CV = """cvs AS (SELECT horizon, avg(cv) AS sigma_cv, count(*) AS n_dates FROM (
  SELECT horizon, date, stddev_samp(sigma) / avg(sigma) AS cv FROM predicted JOIN samp USING (entity, date) WHERE sigma IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5) a GROUP BY 1)"""
RISK_CTES = [BARS, FOLD_ROWS, SAMPLES, PREDICTED, RISK_PANEL]


def sigma_panel(spark, sf_dir) -> DataFrame:
    from barweave.operators.splits import sample_index
    y = sample_index(bars(spark, sf_dir), LENGTH, [1, 2, 4]).select("entity", "date", "horizon", F.col("y_logret").alias("actual"))
    return predictions(spark, sf_dir).join(y, ["entity", "date"])


@query("sigma_dispersion", "horizon:i sigma_cv:f n_dates:i", "SELECT * FROM cvs",
       [BARS, FOLD_ROWS, SAMPLES, PREDICTED, SIGMA_CV])
def sigma_dispersion(spark, sf_dir):
    return mt.sigma_cv(sigma_panel(spark, sf_dir).where(F.col("horizon").isin(HORIZONS)), ["horizon"])


@query("sharpe_gap_identity", "horizon:i date:d sharpe_gap:f",
       """SELECT horizon, date, sum(mu * mu / (sigma * sigma)) - sum(mu) * sum(mu) / sum(sigma * sigma) AS sharpe_gap
  FROM predicted JOIN samp USING (entity, date) WHERE mu IS NOT NULL AND sigma IS NOT NULL GROUP BY 1, 2""", [BARS, FOLD_ROWS, SAMPLES, PREDICTED])
def sharpe_gap_identity(spark, sf_dir):
    return mt.sharpe_gap(sigma_panel(spark, sf_dir).where(F.col("horizon").isin(HORIZONS)), ["horizon"])


YEAR_POINTS = """points AS (SELECT year, avg(cv) AS cv, avg(gap) AS gap FROM (
  SELECT year(date) AS year, date, stddev_samp(sigma) / avg(sigma) AS cv, sum(mu * mu / (sigma * sigma)) - sum(mu) * sum(mu) / sum(sigma * sigma) AS gap
  FROM predicted WHERE mu IS NOT NULL AND sigma IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5) a GROUP BY 1)"""


@query("gap_vs_dispersion", "n:i pearson:f spearman:f",
       f"SELECT count(*) AS n, {sql_corr('cv', 'gap', '')} AS pearson, {sql_corr('rx', 'ry', '')} AS spearman FROM (SELECT *, rank() OVER (ORDER BY cv) AS rx, rank() OVER (ORDER BY gap) AS ry FROM points) p HAVING count(*) >= 3",
       [BARS, PREDICTED, YEAR_POINTS])
def gap_vs_dispersion(spark, sf_dir):
    p = predictions(spark, sf_dir).where(F.col("mu").isNotNull() & F.col("sigma").isNotNull()).withColumn("year", F.year("date"))
    cv = mt.sigma_by_date(p, ["year"]).join(mt.sharpe_gap(p, ["year"]), ["year", "date"])
    points = cv.groupBy("year").agg(F.avg("cv").alias("cv"), F.avg("sharpe_gap").alias("gap"))
    return mt.gap_vs_dispersion(points, "cv", "gap")


# ---- reporting ---------------------------------------------------------------------------

ARM_COSTS = f"""arms AS (SELECT horizon, fold, strategy AS arm, net_sharpe, avg_turnover_per_rebalance AS turnover FROM cost_table WHERE top_n = 5 AND cost_bps = 20)"""


@query("arm_pivot", "horizon:i fold:s net_sharpe_xs_momentum:f net_sharpe_xs_reversal:f turnover_xs_momentum:f turnover_xs_reversal:f",
       """SELECT horizon, fold, max(net_sharpe) FILTER (arm = 'xs_momentum') AS net_sharpe_xs_momentum, max(net_sharpe) FILTER (arm = 'xs_reversal') AS net_sharpe_xs_reversal,
  max(turnover) FILTER (arm = 'xs_momentum') AS turnover_xs_momentum, max(turnover) FILTER (arm = 'xs_reversal') AS turnover_xs_reversal FROM arms GROUP BY 1, 2""",
       [*PORT_CTES, COSTED, COST_TABLE, ARM_COSTS])
def arm_pivot(spark, sf_dir):
    costs = cost_table(test_panel(spark, sf_dir), [5]).where(F.col("cost_bps") == 20.0)
    arms = costs.select("horizon", "fold", F.col("strategy").alias("arm"), "net_sharpe", F.col("avg_turnover_per_rebalance").alias("turnover"))
    return rp.pivot_arms(arms, ["horizon", "fold"], ["xs_momentum", "xs_reversal"], ["net_sharpe", "turnover"])


@query("best_cell", f"{SERIES_SPEC} net_sharpe:f",
       f"SELECT * FROM cost_table WHERE cost_bps = 20 AND net_sharpe IS NOT NULL ORDER BY net_sharpe DESC, {BY_SERIES} LIMIT 1", [*PORT_CTES, COSTED, COST_TABLE])
def best_cell(spark, sf_dir):
    return rp.best_cell(cost_table(test_panel(spark, sf_dir)).where(F.col("cost_bps") == 20.0), "net_sharpe", SERIES)


@query("zip_pairs", "horizon:i fold:s i:i a:f b:f n:i",
       """SELECT horizon, fold, i, a.net AS a, b.net AS b, count(*) OVER (PARTITION BY horizon, fold) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY horizon, fold ORDER BY row_idx) - 1 AS i FROM net WHERE net IS NOT NULL AND strategy = 'xs_momentum' AND top_n = 5) a JOIN (
  SELECT *, row_number() OVER (PARTITION BY horizon, fold ORDER BY row_idx) - 1 AS i FROM net WHERE net IS NOT NULL AND strategy = 'xs_reversal' AND top_n = 42) b USING (horizon, fold, i)""",
       [*WIDE_CTES, NET])
def zip_pairs(spark, sf_dir):
    ts = pf.non_overlap(portfolio(test_panel(spark, sf_dir), WIDE))
    arm = lambda s, n: ts.where((F.col("strategy") == s) & (F.col("top_n") == n))
    return pair_arms(arm("xs_momentum", 5), arm("xs_reversal", 42), ["horizon", "fold"])


@query("cell_grid", "strategy:s fold:s horizon:i arm:s",
       """SELECT strategy, fold, horizon, arm FROM (SELECT DISTINCT strategy, fold FROM panel) c, (VALUES (1), (4), (8)) h(horizon), (VALUES ('mse'), ('riskhead')) a(arm)
  WHERE NOT (arm = 'mse' AND EXISTS (SELECT 1 FROM panel p WHERE p.strategy = c.strategy AND p.fold = c.fold AND p.horizon = h.horizon))""", PANEL_CTES)
def cell_grid(spark, sf_dir):
    done = test_panel(spark, sf_dir).select(*CELL).distinct().withColumn("arm", F.lit("mse"))
    return rp.grid(done.select("strategy", "fold").distinct(), ["mse", "riskhead"], [1, 4, 8], done, ["strategy", "fold", "horizon", "arm"])
