"""Queries: rank ICs, bootstrap, multiple testing, deflated Sharpe, risk scores, summaries and streams."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.functions import maths
from barweave.functions.maths import norm_cdf, norm_ppf
from barweave.operators import bootstrap as bs
from barweave.operators import features as ft
from barweave.operators import inference as inf
from barweave.operators import metrics as mt
from barweave.operators import portfolio as pf
from barweave.operators import report as rp
from barweave.operators import risk as rk
from barweave.operators.evaluate import COST_METRICS, evaluate_cells
from barweave.plans.fixtures import (
    ARTICLES, BARS, CELL, FOLD_ROWS, FOLDS, PANEL_CTES, SAMPLES, SIGNAL_CTES, VAL_CTES, bars, score_events, signals, table, test_panel, val_panel,
)
from barweave.plans.registry import query
from barweave.plans.rolling import W, sql_corr
from barweave.plans.selection import BLOCK_AGGS, BLOCK_FAILURES
from barweave.plans.trading import (
    BY_SERIES, CELL_SPEC, CELLS, COSTED, COST_TABLE, GRID, LONG_POS, NET, PORT, PORT_CTES, POS, PREDICTED, RANKED, ROWS, SERIES, SWEPT, VAL_PORT_CTES, VAL_SIDE,
    cost_rows, gate_sql, port_sql, portfolio, pos_sql, predictions, sharpe_sql, sigma_panel, sweep,
)
from barweave.session import cut_lineage, scratch_path, stored
from barweave.sources import load_summaries, write_summaries
from barweave.streaming import audit_micro_batches, audit_stream, daily_sentiment_stream, drain, latest_blocks

# ---- rank information coefficients --------------------------------------------------------

IC = f"""ranks AS (
  SELECT {CELLS}, date, rank() OVER (PARTITION BY {CELLS}, date ORDER BY pred) + (count(*) OVER (PARTITION BY {CELLS}, date, pred) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY {CELLS}, date ORDER BY actual) + (count(*) OVER (PARTITION BY {CELLS}, date, actual) - 1) / 2.0 AS ry
  FROM panel WHERE pred IS NOT NULL AND actual IS NOT NULL),
ic AS MATERIALIZED (SELECT {CELLS}, date, n, CASE WHEN va > 0 AND vb > 0 THEN cv / sqrt(va * vb) END AS ic FROM (
  SELECT {CELLS}, date, count(*) AS n, sum(rx * ry) - count(*) * pow((count(*) + 1) / 2.0, 2) AS cv, sum(rx * rx) - count(*) * pow((count(*) + 1) / 2.0, 2) AS va,
    sum(ry * ry) - count(*) * pow((count(*) + 1) / 2.0, 2) AS vb FROM ranks GROUP BY {CELLS}, date HAVING count(*) >= 5) s)"""
IC_ROWS = f"""icrow AS MATERIALIZED (SELECT r.*, ic.ic FROM prow r LEFT JOIN ic USING (strategy, horizon, fold, date))"""
IC_CTES = [*PANEL_CTES, IC]
IC_ROW_CTES = [*IC_CTES, ROWS, IC_ROWS]


def daily_ic(spark, sf_dir) -> DataFrame:
    return inf.rank_ic(test_panel(spark, sf_dir), CELL)


def ic_rows(spark, sf_dir) -> DataFrame:
    panel = stored(test_panel(spark, sf_dir), "panel")
    return inf.ic_series(panel, inf.rank_ic(panel, CELL), pf.panel_rows(panel, CELL), CELL)


@query("rank_ic_spearman", f"{CELL_SPEC} date:d n:i ic:f", "SELECT * FROM ic", IC_CTES)
def rank_ic_spearman(spark, sf_dir):
    return daily_ic(spark, sf_dir)


# Signals rounded to whole numbers so that both rankings carry ties.
@query("rank_ic_kendall", f"{CELL_SPEC} date:d n:i ic:f",
       f"""SELECT {CELLS}, date, max(n) AS n, CASE WHEN sum(abs(sx)) > 0 AND sum(abs(sy)) > 0 THEN sum(sx * sy) / sqrt(CAST(sum(abs(sx)) AS DOUBLE) * sum(abs(sy))) END AS ic FROM (
  SELECT a.strategy, a.horizon, a.fold, a.date, a.n, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM coarse a JOIN coarse b
  ON a.strategy = b.strategy AND a.horizon = b.horizon AND a.fold = b.fold AND a.date = b.date AND a.entity < b.entity) p WHERE n >= 5 GROUP BY {CELLS}, date""",
       [*PANEL_CTES, f"""coarse AS MATERIALIZED (SELECT {CELLS}, date, entity, round(pred * 4) AS x, round(actual * 4) AS y, count(*) OVER (PARTITION BY {CELLS}, date) AS n
  FROM panel WHERE pred IS NOT NULL)"""])
def rank_ic_kendall(spark, sf_dir):
    coarse = test_panel(spark, sf_dir).withColumns({"pred": F.round(F.col("pred") * 4), "actual": F.round(F.col("actual") * 4)})
    return inf.rank_ic(coarse, CELL, "kendall")


@query("ic_hit_rate", f"{CELL_SPEC} hit_rate:f",
       f"SELECT {CELLS}, avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate FROM ic WHERE ic IS NOT NULL GROUP BY {CELLS}", IC_CTES)
def ic_hit_rate(spark, sf_dir):
    return inf.ic_hit_rate(daily_ic(spark, sf_dir), CELL)


@query("icir_daily", f"{CELL_SPEC} n:i icir_daily:f",
       f"SELECT {CELLS}, count(ic) AS n, CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) * sqrt(252.0) END AS icir_daily FROM ic GROUP BY {CELLS}", IC_CTES)
def icir_daily(spark, sf_dir):
    return inf.icir_daily(daily_ic(spark, sf_dir), CELL)


@query("val_rank_ic", f"{CELL_SPEC} n_days:i val_rank_ic:f",
       f"SELECT {CELLS}, count(ic) AS n_days, coalesce(avg(ic), 0.0) AS val_rank_ic FROM ic GROUP BY {CELLS}", [*VAL_CTES, IC])
def val_rank_ic(spark, sf_dir):
    return inf.val_rank_ic(val_panel(spark, sf_dir), CELL)


def newey_sql(source: str, lag: str) -> str:
    """HAC error of ``ic`` over the known rows of ``source`` in row order."""
    return f"""known AS MATERIALIZED (SELECT {CELLS}, {lag} AS lg, row_number() OVER (PARTITION BY {CELLS} ORDER BY row_idx) - 1 AS i, count(*) OVER (PARTITION BY {CELLS}) AS n,
    ic - avg(ic) OVER (PARTITION BY {CELLS}) AS x FROM {source} WHERE ic IS NOT NULL),
nw AS (SELECT {CELLS}, n, CASE WHEN n >= 2 AND s > 0 THEN sqrt(s / n) END AS nw_se FROM (
  SELECT a.*, g0 + coalesce(gk, 0) AS s FROM (SELECT {CELLS}, max(n) AS n, avg(x * x) AS g0 FROM known GROUP BY {CELLS}) a LEFT JOIN (
    SELECT a.strategy, a.horizon, a.fold, sum(2 * (1 - (a.i - b.i) / (a.lg + 1.0)) * a.x * b.x / a.n) AS gk FROM known a JOIN known b
    ON a.strategy = b.strategy AND a.horizon = b.horizon AND a.fold = b.fold AND a.i - b.i BETWEEN 1 AND least(a.lg, a.n - 1) GROUP BY 1, 2, 3) g USING (strategy, horizon, fold)) q)"""


@query("newey_west_se", f"{CELL_SPEC} n:i nw_se:f", "SELECT * FROM nw", [*IC_ROW_CTES, newey_sql("icrow", "5")])
def newey_west_se(spark, sf_dir):
    return inf.newey_west(ic_rows(spark, sf_dir), CELL, "ic", 5)


@query("ic_summary", f"{CELL_SPEC} n_obs:i ic_mean:f ic_std:f icir:f nw_lag:i nw_se:f nw_tstat:f",
       f"""SELECT *, CASE WHEN nw_se > 1e-12 THEN ic_mean / nw_se END AS nw_tstat FROM (
  SELECT {CELLS}, count(ic) AS n_obs, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) * sqrt(252.0 / horizon) END AS icir,
    horizon - 1 AS nw_lag FROM icgrid GROUP BY {CELLS}) a LEFT JOIN (SELECT {CELLS}, nw_se FROM nw) b USING (strategy, horizon, fold)""",
       [*IC_ROW_CTES, "icgrid AS MATERIALIZED (SELECT * FROM icrow WHERE row_idx % horizon = 0)", newey_sql("icgrid", "horizon - 1")])
def ic_summary(spark, sf_dir):
    return inf.ic_summary(ic_rows(spark, sf_dir), CELL)


# ---- bootstrap -------------------------------------------------------------------------------

REPS = 2000
BLOCK_OF_N = "CASE WHEN n < 4 THEN 2.0 ELSE greatest(2.0, pow(n, 1.0 / 3.0)) END"
FIVE = "five AS MATERIALIZED (SELECT * FROM net WHERE top_n = 5)"
FIVE_CTES = [*SIGNAL_CTES, PANEL_CTES[-1], RANKED, pos_sql([5]), ROWS, port_sql(), NET, FIVE]
RETURNS = f"""rets AS MATERIALIZED (SELECT {CELLS}, net, i, n, {BLOCK_OF_N} AS block FROM (
  SELECT {CELLS}, net, row_number() OVER (PARTITION BY {CELLS} ORDER BY row_idx) - 1 AS i, count(*) OVER (PARTITION BY {CELLS}) AS n FROM five WHERE net IS NOT NULL) a)"""


def five(spark, sf_dir) -> DataFrame:
    """Net returns of the five-name books on the rebalance rows."""
    return pf.non_overlap(portfolio(test_panel(spark, sf_dir), [5]))


def resample_sql(source: str, keys: list[str], values: list[str], reps: int, seed: int, horizon: str = "horizon") -> str:
    """Blocks by one md5 each: eight hex digits for the geometric length, eight for the start; cut where the lengths reach n."""
    k = ", ".join(keys)
    cell = " || '/' || ".join(keys)
    digits = lambda at: f"(('0x' || substr(h, {at}, 8))::UBIGINT / 4294967296.0)"
    sharpes = ", ".join(f"{sharpe_sql('r.' + v, 'max(r.' + horizon + ')')} AS s_{v}" for v in values)
    return f"""cut AS (SELECT {k}, rep, n, pos, len, CAST(coalesce(sum(len) OVER (PARTITION BY {k}, rep ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS done FROM (
    SELECT *, 1 + CAST(floor(ln(1.0 - {digits(1)}) / ln(1.0 - 1.0 / block)) AS BIGINT) AS len, CAST(floor({digits(9)} * n) AS BIGINT) AS pos FROM (
      SELECT {k}, i AS j, n, block, rep, md5('{seed}|' || {cell} || '|' || rep || '|' || i) AS h FROM {source}, (SELECT unnest(generate_series(0, {reps - 1})) AS rep) g) a) b),
drawn AS (SELECT {k}, rep, (pos + unnest(generate_series(0, least(len, n - done) - 1))) % n AS pick FROM cut WHERE done < n),
boot AS MATERIALIZED (SELECT {', '.join('d.' + x for x in keys)}, d.rep, {sharpes} FROM drawn d JOIN {source} r
  ON {' AND '.join(f'd.{x} = r.{x}' for x in keys)} AND r.i = d.pick GROUP BY {', '.join('d.' + x for x in keys)}, d.rep)"""


BOOT = resample_sql("rets", CELL, ["net"], REPS, 42)


@query("stationary_bootstrap", f"{CELL_SPEC} rep:i s_net:f", "SELECT * FROM boot", [*FIVE_CTES, RETURNS, BOOT])
def stationary_bootstrap(spark, sf_dir):
    return bs.stationary_bootstrap(five(spark, sf_dir), CELL, REPS)


@query("block_length", f"{CELL_SPEC} n:i block:f", f"SELECT DISTINCT {CELLS}, n, block FROM rets", [*FIVE_CTES, RETURNS])
def block_length(spark, sf_dir):
    return bs.block_length(five(spark, sf_dir), CELL)


PW = """pw_x AS MATERIALIZED (SELECT strategy, horizon, fold, i, n, net - avg(net) OVER (PARTITION BY strategy, horizon, fold) AS x FROM rets),
pw_lag AS MATERIALIZED (SELECT l.*, c0, abs(c) < 2 * sqrt(log10(n) / n) * c0 AS quiet FROM (
  SELECT a.strategy, a.horizon, a.fold, a.n, a.i - b.i AS lag, sum(a.x * b.x) / a.n AS c FROM pw_x a JOIN pw_x b ON a.strategy = b.strategy AND a.horizon = b.horizon AND a.fold = b.fold
    AND a.i - b.i BETWEEN 1 AND least(CAST(ceil(sqrt(a.n)) AS BIGINT) + 5, a.n - 1) GROUP BY a.strategy, a.horizon, a.fold, a.n, a.i - b.i) l JOIN (SELECT strategy, horizon, fold, avg(x * x) AS c0 FROM pw_x GROUP BY 1, 2, 3) v USING (strategy, horizon, fold)),
pw_m AS (SELECT strategy, horizon, fold, least(coalesce(2 * min(lag) FILTER (calm = 5), max(lag)), max(lag)) AS m FROM (
  SELECT *, count(*) FILTER (quiet) OVER (PARTITION BY strategy, horizon, fold ORDER BY lag ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS calm FROM pw_lag) q GROUP BY 1, 2, 3),
pw_s AS (SELECT strategy, horizon, fold, n, max(c0) + 2 * sum(wt * c) AS lr, 2 * sum(wt * lag * c) AS g FROM (
  SELECT l.*, CASE WHEN lag * 1.0::DOUBLE / m <= 0.5 THEN 1.0::DOUBLE ELSE 2 * (1 - lag * 1.0::DOUBLE / m) END AS wt FROM pw_lag l JOIN pw_m USING (strategy, horizon, fold) WHERE lag <= m) z GROUP BY 1, 2, 3, 4)"""


AUTO = """auto AS MATERIALIZED (SELECT strategy, horizon, fold, n, CASE WHEN n >= 4 AND b >= 2 THEN b WHEN n < 4 THEN 2.0 ELSE greatest(2.0, pow(n, 1.0 / 3.0)) END AS block FROM (
  SELECT *, CASE WHEN abs(lr) > 1e-12 THEN least(pow(g * g / (lr * lr) * n, 1.0 / 3.0), ceil(least(3 * sqrt(n), n / 3.0))) END AS b
  FROM (SELECT DISTINCT strategy, horizon, fold, n FROM rets) r LEFT JOIN pw_s USING (strategy, horizon, fold, n)) q)"""


@query("block_length_automatic", f"{CELL_SPEC} n:i block:f", "SELECT * FROM auto", [*FIVE_CTES, RETURNS, PW, AUTO])
def block_length_automatic(spark, sf_dir):
    return bs.block_length(five(spark, sf_dir), CELL, automatic=True)


def quantiles_sql(v: str, name: str) -> str:
    return ", ".join(f"quantile_cont({v}, {p}) AS {name}_{s}" for p, s in (("0.025", "lo"), ("0.5", "md"), ("0.975", "hi")))


POINT = f"point AS (SELECT {CELLS}, max(n) AS n, max(block) AS block, {sharpe_sql('net', 'max(horizon)')} AS point_net FROM blocked GROUP BY {CELLS})"
BLOCKED = "blocked AS MATERIALIZED (SELECT r.strategy, r.horizon, r.fold, r.net, r.i, r.n, a.block FROM rets r JOIN auto a USING (strategy, horizon, fold))"
AUTO_BOOT = resample_sql("blocked", CELL, ["net"], REPS, 42)


@query("sharpe_ci", f"{CELL_SPEC} n:i block:f point_net:f sharpe_lo:f sharpe_md:f sharpe_hi:f boot_se:f point_percentile:f status:s",
       f"""SELECT p.*, sharpe_lo, sharpe_md, sharpe_hi, boot_se, point_percentile, CASE WHEN n < 6 THEN 'refused' WHEN n < 12 THEN 'small' ELSE 'ok' END AS status FROM point p LEFT JOIN (
  SELECT {CELLS}, {quantiles_sql('s_net', 'sharpe')}, stddev_samp(s_net) AS boot_se, avg(CASE WHEN s_net < point_net - 1e-9 THEN 1.0::DOUBLE WHEN s_net IS NULL THEN NULL ELSE 0 END) * 100 AS point_percentile
  FROM boot JOIN point USING (strategy, horizon, fold) WHERE n >= 6 GROUP BY {CELLS}) b USING (strategy, horizon, fold)""", [*FIVE_CTES, RETURNS, PW, AUTO, BLOCKED, AUTO_BOOT, POINT])
def sharpe_ci(spark, sf_dir):
    return bs.sharpe_ci(five(spark, sf_dir), CELL, REPS, "auto")


HF = ["horizon", "fold"]
PAIRS = f"""raw_pairs AS MATERIALIZED (SELECT horizon, fold, i, a.net AS a, b.net AS b, count(*) OVER (PARTITION BY horizon, fold) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY horizon, fold ORDER BY row_idx) - 1 AS i FROM five WHERE net IS NOT NULL AND strategy = 'xs_momentum') a JOIN
  (SELECT *, row_number() OVER (PARTITION BY horizon, fold ORDER BY row_idx) - 1 AS i FROM five WHERE net IS NOT NULL AND strategy = 'xs_reversal') b USING (horizon, fold, i))"""
#: Plug-in block of each arm of ``raw_pairs``, and their mean.
ARM_BLOCKS = ["rets AS MATERIALIZED (SELECT 'a' AS strategy, horizon, fold, i, n, a AS net FROM raw_pairs UNION ALL SELECT 'b', horizon, fold, i, n, b FROM raw_pairs)",
              PW, AUTO, "mean_block AS (SELECT horizon, fold, avg(block) AS block FROM auto GROUP BY 1, 2)"]
PAIR_BLOCKS = [*ARM_BLOCKS, "pairs AS MATERIALIZED (SELECT p.*, m.block FROM raw_pairs p JOIN mean_block m USING (horizon, fold))"]
PAIR_BOOT = resample_sql("pairs", HF, ["a", "b"], REPS, 42)
PAIRED = f"""paired AS (SELECT *, point_a - point_b AS point_diff FROM (
  SELECT horizon, fold, max(n) AS n, {sharpe_sql('a', 'max(horizon)')} AS point_a, {sharpe_sql('b', 'max(horizon)')} AS point_b FROM pairs GROUP BY 1, 2) p LEFT JOIN (
  SELECT horizon, fold, count(*) AS n_valid, {quantiles_sql('s_a', 'a')}, {quantiles_sql('s_b', 'b')}, {quantiles_sql('s_a - s_b', 'diff')},
    avg(CASE WHEN s_a - s_b <= 0 THEN 1.0::DOUBLE ELSE 0 END) AS p_one_sided, stddev_samp(s_a - s_b) AS se_diff
  FROM boot WHERE s_a IS NOT NULL AND s_b IS NOT NULL GROUP BY 1, 2) b USING (horizon, fold))"""


def arm_pairs(spark, sf_dir) -> DataFrame:
    return bs.pair_columns(five(spark, sf_dir), HF, "strategy", "xs_momentum", "xs_reversal")


@query("paired_bootstrap", "horizon:i fold:s n:i n_valid:i point_a:f point_b:f point_diff:f a_lo:f a_md:f a_hi:f b_lo:f b_md:f b_hi:f diff_lo:f diff_md:f diff_hi:f p_one_sided:f",
       "SELECT * FROM paired", [*FIVE_CTES, PAIRS, *PAIR_BLOCKS, PAIR_BOOT, PAIRED])
def paired_bootstrap(spark, sf_dir):
    return bs.paired_bootstrap(arm_pairs(spark, sf_dir), HF, REPS, "auto")


@query("studentized_diff", "horizon:i fold:s n_valid:i se_diff:f student_lo:f student_hi:f",
       """SELECT p.*, CASE WHEN n_valid >= 100 AND se_diff >= 1e-12 THEN point_diff - t_hi * se_diff END AS student_lo, CASE WHEN n_valid >= 100 AND se_diff >= 1e-12 THEN point_diff - t_lo * se_diff END AS student_hi FROM paired p LEFT JOIN (
  SELECT horizon, fold, quantile_cont((s_a - s_b - point_diff) / se_diff, 0.025) AS t_lo, quantile_cont((s_a - s_b - point_diff) / se_diff, 0.975) AS t_hi
  FROM boot JOIN paired USING (horizon, fold) GROUP BY 1, 2) t USING (horizon, fold)""", [*FIVE_CTES, PAIRS, *PAIR_BLOCKS, PAIR_BOOT, PAIRED])
def studentized_diff(spark, sf_dir):
    return bs.paired_bootstrap(arm_pairs(spark, sf_dir), HF, REPS, "auto", studentized=True)


DAILY_FIVE = "dfive AS MATERIALIZED (SELECT *, gross - 20.0 / 10000.0 * turnover AS dnet FROM port WHERE top_n = 5)"


def daily_pairs(where: str) -> str:
    arm = lambda s: f"(SELECT *, row_number() OVER (PARTITION BY horizon, fold ORDER BY row_idx) - 1 AS i FROM dfive WHERE dnet IS NOT NULL AND strategy = '{s}' AND {where})"
    return (f"SELECT horizon, fold, i, a.dnet AS a, b.dnet AS b, count(*) OVER (PARTITION BY horizon, fold) AS n FROM {arm('xs_momentum')} a JOIN {arm('xs_reversal')} b USING (horizon, fold, i)")


OVERLAP = f"""grid_pairs AS MATERIALIZED (SELECT * FROM ({daily_pairs('row_idx % horizon = 0')}) q WHERE n >= 40),
raw_pairs AS MATERIALIZED (
  SELECT *, false AS used_overlap FROM grid_pairs UNION ALL SELECT *, true FROM ({daily_pairs('true')}) q WHERE (horizon, fold) NOT IN (SELECT (horizon, fold) FROM grid_pairs))"""
OVERLAP_PAIRS = """pairs AS MATERIALIZED (SELECT p.*, CASE WHEN used_overlap THEN greatest(m.block, CAST(horizon AS DOUBLE)) ELSE m.block END AS block,
    CASE WHEN used_overlap THEN 1 ELSE horizon END AS eff FROM raw_pairs p JOIN mean_block m USING (horizon, fold) WHERE n >= 40)"""
OVERLAP_BOOT = resample_sql("pairs", HF, ["a", "b"], REPS, 2026, "eff")
OVERLAP_PAIRED = PAIRED.replace("max(horizon)", "max(eff)").replace("max(n) AS n,", "max(n) AS n, bool_or(used_overlap) AS used_overlap,")


@query("overlap_fallback", "horizon:i fold:s n:i used_overlap:b n_valid:i point_diff:f diff_lo:f diff_hi:f p_one_sided:f status:s",
       """SELECT c.*, n_valid, point_diff, diff_lo, diff_hi, p_one_sided, CASE WHEN c.n < 40 THEN 'refused' WHEN coalesce(n_valid, 0) < 100 THEN 'few' ELSE 'ok' END AS status
  FROM (SELECT horizon, fold, max(n) AS n, bool_or(used_overlap) AS used_overlap FROM raw_pairs GROUP BY 1, 2) c
  LEFT JOIN (SELECT * EXCLUDE (n, used_overlap) FROM paired) p USING (horizon, fold)""",
       [*FIVE_CTES, DAILY_FIVE, OVERLAP, *ARM_BLOCKS, OVERLAP_PAIRS, OVERLAP_BOOT, OVERLAP_PAIRED])
def overlap_fallback(spark, sf_dir):
    ts = cut_lineage(portfolio(test_panel(spark, sf_dir), [5]))
    arm = lambda s: ts.where(F.col("strategy") == s)
    return bs.paired_by_cell(arm("xs_momentum"), arm("xs_reversal"), HF, 40, REPS)


ADJUSTED = """SELECT *, p_holm < 0.05 AS significant_holm, p_bh < 0.05 AS significant_bh FROM (
  SELECT *, max(least(p_value * (m - k + 1), 1)) OVER (ORDER BY k) AS p_holm, min(least(p_value * m / k, 1)) OVER (ORDER BY k DESC) AS p_bh FROM (
    SELECT horizon, fold, p_one_sided AS p_value, row_number() OVER (ORDER BY p_one_sided, horizon || '/' || fold) AS k, count(*) OVER () AS m FROM paired WHERE p_one_sided IS NOT NULL) a) b"""


def register_adjusted(name: str, columns: str) -> None:
    @query(name, f"horizon:i fold:s p_value:f {columns}", ADJUSTED, [*FIVE_CTES, PAIRS, *PAIR_BLOCKS, PAIR_BOOT, PAIRED])
    def run(spark, sf_dir):
        p = paired_bootstrap(spark, sf_dir).withColumn("hypothesis", F.concat_ws("/", *HF))
        return inf.multiple_testing(p.withColumn("p_value", F.col("p_one_sided")), [])


register_adjusted("holm", "p_holm:f significant_holm:b")
register_adjusted("bh_fdr", "p_bh:f significant_bh:b")


# ---- deflated Sharpe ---------------------------------------------------------------------------

def horner(cs: list[float], x: str) -> str:
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    body = f"exp(-{a} * {a} / 2.0) * {horner(maths.CDF_NUM, a)} / {horner(maths.CDF_DEN, a)}"
    frac = f"({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65)))))"
    tail = f"CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {body} ELSE exp(-{a} * {a} / 2.0) / {frac} / 2.506628274631 END"
    return f"CASE WHEN {x} > 0 THEN 1.0 - ({tail}) ELSE ({tail}) END"


def ppf_sql(p: str) -> str:
    q = f"({p} - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    r = f"sqrt(-ln(least({p}, 1.0 - {p})))"
    part = lambda num, den, v: f"({horner(num, v)}) / ({horner(den, v)})"
    outer = (f"CASE WHEN {r} <= 5 THEN {part(maths.PPF_SHOULDER_NUM, maths.PPF_SHOULDER_DEN, f'({r} - 1.6)')} "
             f"ELSE {part(maths.PPF_TAIL_NUM, maths.PPF_TAIL_DEN, f'({r} - 5.0)')} END")
    centre = f"{q} * {part(maths.PPF_CENTRE_NUM, maths.PPF_CENTRE_DEN, rc)}"
    return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({q}) <= 0.425 THEN {centre} WHEN {q} < 0 THEN -({outer}) ELSE ({outer}) END"


@query("normal_functions", "event_id:i cdf:f ppf:f",
       f"SELECT event_id, {cdf_sql('z')} AS cdf, {ppf_sql('u')} AS ppf FROM (SELECT event_id, (value - 50.0::DOUBLE) / 40 AS z, (value + 0.5::DOUBLE) / 600 AS u FROM events) e")
def normal_functions(spark, sf_dir):
    z, u = (F.col("value") - 50.0) / 40, (F.col("value") + 0.5) / 600
    return table(spark, sf_dir, "events").select("event_id", norm_cdf(z).alias("cdf"), norm_ppf(u).alias("ppf"))


MOMENTS = f"""mom AS (SELECT {CELLS}, n_obs, mean, sd, CASE WHEN n_obs >= 4 AND sd > 1e-12 THEN m3 / pow(sd, 3) END AS skew, CASE WHEN n_obs >= 4 AND sd > 1e-12 THEN m4 / pow(sd, 4) END AS kurt FROM (
  SELECT {CELLS}, count(net) AS n_obs, max(mu) AS mean, stddev_samp(net) AS sd, avg(pow(net - mu, 3)) AS m3, avg(pow(net - mu, 4)) AS m4
  FROM (SELECT *, avg(net) OVER (PARTITION BY {CELLS}) AS mu FROM five) a GROUP BY {CELLS}) b)"""


@query("moments", f"{CELL_SPEC} n_obs:i mean:f sd:f skew:f kurt:f", "SELECT * FROM mom", [*FIVE_CTES, MOMENTS])
def moments(spark, sf_dir):
    return mt.moments(five(spark, sf_dir), CELL)


@query("per_period_sharpe", f"{CELL_SPEC} n_obs:i sr:f",
       f"SELECT {CELLS}, count(net) AS n_obs, CASE WHEN count(net) >= 2 AND stddev_samp(net) >= 1e-12 THEN avg(net) / stddev_samp(net) END AS sr FROM five GROUP BY {CELLS}", FIVE_CTES)
def per_period_sharpe(spark, sf_dir):
    return inf.per_period_sharpe(five(spark, sf_dir), CELL)


TRIALS = "tv AS (SELECT fold, horizon, count(val_sharpe) AS n_trials, var_samp(val_sharpe / sqrt(252.0 / horizon)) AS trial_var FROM swept GROUP BY 1, 2)"


@query("trial_variance", "fold:s horizon:i n_trials:i trial_var:f", "SELECT * FROM tv", [*VAL_PORT_CTES, SWEPT, TRIALS])
def trial_variance(spark, sf_dir):
    return inf.trial_variance(sweep(val_panel(spark, sf_dir)), ["fold", "horizon"], sharpe="val_sharpe")


def emax_sql(n: str, var: str) -> str:
    g = inf.EULER_GAMMA
    return (f"CASE WHEN {n} >= 2 AND {var} > 0 THEN sqrt({var}) * ({1 - g!r} * ({ppf_sql(f'(1.0 - 1.0::DOUBLE / {n})')}) "
            f"+ {g!r} * ({ppf_sql(f'(1.0 - 1.0::DOUBLE / ({n} * {math.e!r}))')})) END")


@query("expected_max_sharpe", "fold:s horizon:i sr_zero:f", f"SELECT fold, horizon, {emax_sql('n_trials', 'trial_var')} AS sr_zero FROM tv", [*VAL_PORT_CTES, SWEPT, TRIALS])
def expected_max_sharpe(spark, sf_dir):
    tv = inf.trial_variance(sweep(val_panel(spark, sf_dir)), ["fold", "horizon"], sharpe="val_sharpe")
    return tv.withColumn("sr_zero", inf.expected_max_sharpe("n_trials", "trial_var"))


def renamed(ctes: list[str], old: dict[str, str]) -> list[str]:
    """The same CTE chain under other names, so that one statement can hold two panels."""
    out = []
    for c in ctes:
        for a, b in old.items():
            c = re.sub(rf"\b{a}\b", b, c)
        out.append(c)
    return out


VAL_NAMES = {n: f"v_{n}" for n in ("panel", "ranked", "pos", "sizes", "prow", "placed", "traded", "port", "swept")}
VAL_TAIL = renamed([VAL_CTES[-1], *VAL_PORT_CTES[len(VAL_CTES):], SWEPT], VAL_NAMES)
DSR_SOLVED = f"""pool AS (SELECT fold, count(val_sharpe) AS n_trials, var_samp(val_sharpe) AS va FROM v_swept GROUP BY 1),
solved AS (SELECT *, {emax_sql('n_trials', 'trial_var')} AS sr_zero FROM (
  SELECT mom.*, n_trials, va / (252.0::DOUBLE / horizon) AS trial_var, mean / sd AS sr FROM mom LEFT JOIN pool USING (fold)) a),
dsr AS (SELECT *, CASE WHEN n_obs >= 2 AND den > 0 THEN {cdf_sql('z')} END AS dsr FROM (
  SELECT *, (sr - sr_zero) * sqrt(n_obs - 1.0::DOUBLE) / sqrt(CASE WHEN den > 0 THEN den END) AS z FROM (
    SELECT *, 1 - skew * sr + (kurt - 1) / 4.0 * sr * sr AS den FROM solved) b) c)"""


@query("deflated_sharpe", f"{CELL_SPEC} n_obs:i n_trials:i sr:f sr_zero:f skew:f kurt:f dsr:f sr_annualised:f significant:b",
       "SELECT *, sr * sqrt(252.0 / horizon) AS sr_annualised, dsr >= 0.95 AS significant FROM dsr", [*FIVE_CTES, MOMENTS, *VAL_TAIL, DSR_SOLVED])
def deflated_sharpe(spark, sf_dir):
    both = cells_of_both(spark, sf_dir)
    return inf.deflated_sharpe(both[0].where(F.col("net").isNotNull()), both[1], CELL, ["fold"], sharpe="val_sharpe")


def cells_of_both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Test returns of the five-name books and the validation sweep."""
    both = all_books(spark, sf_dir)
    test = both.where((F.col("split") == "test") & (F.col("top_n") == 5) & (F.col("cost_bps") == 20.0))
    return pf.non_overlap(test).drop("split"), sweep_of(both.where((F.col("split") == "val") & (F.col("cost_bps") == 0.0)))


def all_books(spark, sf_dir) -> DataFrame:
    """Series of every cell, split, book size and cost from one pass over the signals, written out for reuse."""
    books = pf.backtest(signals(spark, sf_dir), ["split", *CELL], GRID, bps=pf.BPS_GRID)
    return cut_lineage(books)


def sweep_of(val: DataFrame) -> DataFrame:
    ts = pf.non_overlap(val)
    return ts.groupBy(*SERIES).agg(mt.sharpe("gross", "horizon").alias("val_sharpe"), F.count("gross").alias("val_n_obs"))


# ---- cell summaries -------------------------------------------------------------------------------

def arm_column(strategy: str = "strategy"):
    return F.when(F.col(strategy) == "xs_reversal", "riskhead").otherwise("mse")


ARM_SQL = "CASE WHEN strategy = 'xs_reversal' THEN 'riskhead' ELSE 'mse' END"
TRADED_COSTS = [0.0, 20.0, 50.0]


def cell_summaries(books: DataFrame) -> DataFrame:
    """One nested document per cell: cost map of the five-name book and the validation sweep."""
    test = books.where((F.col("split") == "test") & (F.col("top_n") == 5)).drop("split")
    nested = rp.cost_map(cost_rows(test), CELL, COST_METRICS)
    entry = F.struct(F.col("top_n").cast("int").alias("top_n"), F.col("val_sharpe").alias("val_sharpe_gross"), F.col("val_n_obs").cast("long").alias("val_n_obs"))
    val = books.where((F.col("split") == "val") & (F.col("cost_bps") == 0.0)).drop("split")
    swept = sweep_of(val).groupBy(*CELL).agg(F.array_sort(F.collect_list(entry)).alias("sweep_topn"))
    joined = nested.join(swept, CELL, "left").withColumn("arm", arm_column())
    return joined.withColumnRenamed("strategy", "model").withColumn("ic_mean", F.lit(None).cast("double"))


FLAT = f"""flat AS (SELECT strategy AS model, horizon, fold, {ARM_SQL} AS arm, """ + ", ".join(
    f"max({m}) FILTER (cost_bps = {int(b)}) AS c{int(b)}_{m}" for b in TRADED_COSTS for m in ("net_sharpe", "avg_turnover_per_rebalance")) + \
    " FROM cost_table WHERE top_n = 5 GROUP BY 1, 2, 3, 4)"
SUMMARY_CTES = [*SIGNAL_CTES, PANEL_CTES[-1], RANKED, pos_sql([5]), ROWS, port_sql(), COSTED, COST_TABLE, FLAT]


@query("load_cell_summaries", "model:s horizon:i fold:s arm:s n_sizes:i " + " ".join(
    f"c{int(b)}_{m}:f" for b in TRADED_COSTS for m in ("net_sharpe", "avg_turnover_per_rebalance")),
    "SELECT *, 5 AS n_sizes FROM flat", SUMMARY_CTES)
def load_cell_summaries(spark, sf_dir):
    path = scratch_path(spark, "summaries")
    write_summaries(cell_summaries(all_books(spark, sf_dir)), path)
    docs = load_summaries(spark, path, one_per_file=False)
    keys = ["model", "horizon", "fold", "arm"]
    return rp.flatten_costs(docs.withColumn("n_sizes", F.size("sweep_topn")), [*keys, "n_sizes"], TRADED_COSTS, ["net_sharpe", "avg_turnover_per_rebalance"])


@query("trial_pool", "arm:s n:i mean_sharpe:f best_sharpe:f",
       f"SELECT {ARM_SQL} AS arm, count(val_sharpe) AS n, avg(val_sharpe) AS mean_sharpe, max(val_sharpe) AS best_sharpe FROM swept WHERE val_sharpe IS NOT NULL GROUP BY 1",
       [*VAL_PORT_CTES, SWEPT])
def trial_pool(spark, sf_dir):
    docs = cell_summaries(all_books(spark, sf_dir)).withColumn("net_sharpe", F.try_element_at("cost_sensitivity", F.lit("20.0"))["net_sharpe"])
    return rp.trial_pool(docs, ["arm"]).groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg("sharpe").alias("mean_sharpe"), F.max("sharpe").alias("best_sharpe"))


HEADLINE = f"""winner AS (SELECT strategy, horizon, fold, net_sharpe AS winning_sharpe FROM cost_table WHERE top_n = 5 AND cost_bps = 20 AND net_sharpe IS NOT NULL ORDER BY net_sharpe DESC, strategy, horizon, fold LIMIT 1),
solved AS (SELECT *, {emax_sql('n_trials', 'trial_var')} AS sr_zero FROM (
  SELECT mom.*, winning_sharpe, n_trials, va / (252.0::DOUBLE / horizon) AS trial_var, mean / sd AS sr FROM mom JOIN winner USING (strategy, horizon, fold)
  JOIN (SELECT {ARM_SQL} AS arm, count(val_sharpe) AS n_trials, var_samp(val_sharpe) AS va FROM v_swept GROUP BY 1) p ON p.arm = ({ARM_SQL})) a),"""
HEADLINE += DSR_SOLVED[DSR_SOLVED.index("dsr AS ("):]


@query("headline_dsr", "model:s horizon:i fold:s winning_sharpe:f n_trials:i sr_zero:f dsr:f",
       "SELECT strategy AS model, * FROM dsr", [*FIVE_CTES, COSTED, COST_TABLE, MOMENTS, *VAL_TAIL, HEADLINE])
def headline_dsr(spark, sf_dir):
    books = all_books(spark, sf_dir)
    docs = cell_summaries(books).withColumn("c20_net_sharpe", F.try_element_at("cost_sensitivity", F.lit("20.0"))["net_sharpe"])
    won = books.where((F.col("split") == "test") & (F.col("top_n") == 5) & (F.col("cost_bps") == 20.0))
    ts = won.withColumn("arm", arm_column()).withColumnsRenamed({"strategy": "model", "net": "net20"})
    return rp.headline_dsr(docs, ts, ["model", "horizon", "fold", "arm"], "arm", "c20_net_sharpe")


# ---- whole evaluation -----------------------------------------------------------------------------------

TIERS = {1: "full", 2: "aggregate"}
LONG_SIDE = [re.sub(r"\b(pos|sizes|placed|traded|port|costed|cost_table)\b", r"lo_\1", c) for c in [LONG_POS, PORT, COSTED, COST_TABLE]]
EVAL_CTES = [*SIGNAL_CTES, *VAL_SIDE, PANEL_CTES[-1], RANKED, POS, ROWS, PORT, COSTED, COST_TABLE, *LONG_SIDE, IC, IC_ROWS, f"""evaluated AS (
  SELECT b.strategy AS model, b.horizon, b.fold, {ARM_SQL.replace('strategy', 'b.strategy')} AS arm, b.top_n AS best_top_n, n_test_timestamps, n_test_timestamps >= 6 AS inference_valid,
    CASE b.horizon WHEN 1 THEN 'full' WHEN 2 THEN 'aggregate' ELSE 'unknown' END AS ci_tier, ic_mean, ic_std, c.net_sharpe AS net20, lb.net_sharpe AS long_best, l30.net_sharpe AS long_30
  FROM val_best b JOIN (SELECT {CELLS}, count(DISTINCT CASE WHEN pred IS NOT NULL THEN date END) AS n_test_timestamps FROM panel GROUP BY {CELLS}) n USING (strategy, horizon, fold)
  JOIN (SELECT {CELLS}, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std FROM icrow WHERE row_idx % horizon = 0 GROUP BY {CELLS}) i USING (strategy, horizon, fold)
  JOIN cost_table c ON c.strategy = b.strategy AND c.horizon = b.horizon AND c.fold = b.fold AND c.top_n = b.top_n AND c.cost_bps = 20
  JOIN lo_cost_table lb ON lb.strategy = b.strategy AND lb.horizon = b.horizon AND lb.fold = b.fold AND lb.top_n = b.top_n AND lb.cost_bps = 20
  JOIN lo_cost_table l30 ON l30.strategy = b.strategy AND l30.horizon = b.horizon AND l30.fold = b.fold AND l30.top_n = 30 AND l30.cost_bps = 20)"""]


def evaluated(spark, sf_dir) -> DataFrame:
    """Summary documents of every cell, written and read back."""
    docs = evaluate_cells(signals(spark, sf_dir), CELL, GRID, tiers=TIERS).withColumn("arm", arm_column())
    path = scratch_path(spark, "evaluation")
    write_summaries(docs.withColumnRenamed("strategy", "model"), path)
    docs = load_summaries(spark, path, one_per_file=False)
    sharpe = lambda field, key: F.try_element_at(field, F.lit(key))["net_sharpe"]
    return docs.withColumns({"net20": sharpe("cost_sensitivity", "20.0"), "long_best": sharpe("longonly_appendix", "best"), "long_30": sharpe("longonly_appendix", "30")})


@query("evaluate_cells", "model:s horizon:i fold:s arm:s best_top_n:i n_test_timestamps:i inference_valid:b ci_tier:s ic_mean:f ic_std:f net20:f long_best:f long_30:f",
       "SELECT * FROM evaluated", EVAL_CTES)
def evaluate_query(spark, sf_dir):
    return evaluated(spark, sf_dir)


@query("trial_pool_fallbacks", "arm:s horizon:i fold:s n:i mean_sharpe:f",
       f"""SELECT arm, horizon, fold, count(*) AS n, avg(sharpe) AS mean_sharpe FROM (
  SELECT arm, horizon, fold, sharpe FROM trials JOIN rich USING (arm, horizon, fold) UNION ALL
  SELECT arm, horizon, fold, net20 FROM evaluated WHERE net20 IS NOT NULL AND (arm, horizon, fold) NOT IN (SELECT (arm, horizon, fold) FROM rich)) p GROUP BY 1, 2, 3""",
       [*EVAL_CTES, f"""trials AS (SELECT {ARM_SQL} AS arm, horizon, fold, val_sharpe AS sharpe FROM val_swept WHERE fold <> '{FOLDS[0].name}' AND val_sharpe IS NOT NULL
  UNION ALL SELECT arm, horizon, fold, ic_mean FROM evaluated WHERE fold = '{FOLDS[0].name}' AND ic_mean IS NOT NULL)""",
        "rich AS (SELECT arm, horizon, fold FROM trials GROUP BY 1, 2, 3 HAVING count(*) >= 2)"])
def trial_pool_fallbacks(spark, sf_dir):
    """The first fold's documents carry no sweep: their IC means stand in, and where a pool has only one of these, its cell's Sharpe."""
    docs = evaluated(spark, sf_dir).withColumn("sweep_topn", F.when(F.col("fold") != FOLDS[0].name, F.col("sweep_topn")))
    pool = rp.trial_pool(docs, ["arm", "horizon", "fold"], sharpe="net20")
    return pool.groupBy("arm", "horizon", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("sharpe").alias("mean_sharpe"))


# ---- risk scores ------------------------------------------------------------------------------------

RISKY = f"""risky AS MATERIALIZED (SELECT *, tanh(10 * mu / (sigma + 1e-3)) AS position, {gate_sql(1.0, '1.0', '2.0')} AS gate FROM (
  SELECT horizon, entity, date, mu, log_sigma2, log_vol, sigma, actual, log_vol_target FROM (
    SELECT p.*, horizon, y_logret AS actual, t.lvt AS log_vol_target FROM predicted p JOIN samp USING (entity, date) JOIN (
      SELECT entity, date, CASE WHEN count(d) OVER w20 = 20 THEN ln(stddev_pop(d) OVER w20 + 1e-3) END AS lvt FROM (
        SELECT entity, date, ln(close) - ln(lag(close) OVER ({W})) AS d FROM bars) a WINDOW w20 AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) t USING (entity, date)) z
  WHERE mu IS NOT NULL AND sigma IS NOT NULL AND horizon <> 2) y)"""
RISKY_CTES = [BARS, FOLD_ROWS, SAMPLES, PREDICTED, RISKY]


def risky(spark, sf_dir) -> DataFrame:
    logs = bars(spark, sf_dir).withColumn("lc", F.ln("close"))
    target = ft.log_vol_target(logs, "lc").select("entity", "date", "log_vol_target")
    p = sigma_panel(spark, sf_dir).where(F.col("mu").isNotNull() & F.col("sigma").isNotNull() & (F.col("horizon") != 2))
    return rk.with_risk_columns(p, tau_vol=1.0, tau_sigma=2.0).join(target, ["entity", "date"])


def register_score(name: str, columns: str) -> None:
    @query(name, f"horizon:i n:i {columns}",
           """SELECT horizon, count(*) AS n, avg(0.5 * (lv + pow(actual - mu, 2) / exp(lv))) AS gaussian_nll, avg(pow(mu - actual, 2)) AS return_mse,
  avg(pow(log_vol - log_vol_target, 2)) AS vol_mse, avg(gate * position * actual) / (stddev_pop(gate * position * actual) + 1e-3) AS gated_sharpe
  FROM (SELECT *, greatest(-12.0, least(4.0, log_sigma2)) AS lv FROM risky) r GROUP BY 1""", RISKY_CTES)
    def run(spark, sf_dir):
        return rk.risk_scores(risky(spark, sf_dir), ["horizon"])


register_score("gaussian_nll", "gaussian_nll:f")
register_score("return_mse", "return_mse:f")
register_score("vol_mse", "vol_mse:f")
register_score("gated_sharpe", "gated_sharpe:f")


@query("group_portfolio_sharpe", "horizon:i n_groups:i group_sharpe:f",
       """SELECT horizon, count(*) AS n_groups, avg(p) / (stddev_pop(p) + 1e-3) AS group_sharpe FROM (
  SELECT horizon, g, sum(u * actual) / (sum(u) + 1e-9) - sum(d * actual) / (sum(d) + 1e-9) AS p FROM (
    SELECT *, ('0x' || substr(md5('42|' || entity || '|' || strftime(date, '%Y-%m-%d')), 1, 8))::UBIGINT % 8 AS g, greatest(position * gate, 0) AS u, greatest(-position * gate, 0) AS d FROM risky) a
  GROUP BY 1, 2) b GROUP BY 1""", RISKY_CTES)
def group_portfolio_sharpe(spark, sf_dir):
    return rk.group_sharpe(risky(spark, sf_dir), 8, 42, keys=["horizon"])


@query("margin_bce", "horizon:i n:i margin_bce:f",
       """SELECT horizon, count(*) AS n, avg(CASE WHEN pnl > 0 THEN -ln(g) ELSE -ln(1 - g) END) AS margin_bce FROM (
  SELECT horizon, position * actual AS pnl, greatest(1e-6, least(1 - 1e-6, gate)) AS g, quantile_disc(abs(position * actual), 0.5) OVER (PARTITION BY horizon) AS cut FROM risky) a
  WHERE abs(pnl) >= cut GROUP BY 1""", RISKY_CTES)
def margin_bce(spark, sf_dir):
    return rk.margin_bce(risky(spark, sf_dir), ["horizon"])


# ---- streams ---------------------------------------------------------------------------------------------

STREAM_PARTS = 3
FILES_A_BATCH = 8
STREAM_BLOCK = 16
PART_SQL = f"CAST(floor({STREAM_PARTS} * (epoch_us(ts) - lo) / (hi - lo + 1.0)) AS BIGINT)"
PARTS = f"parts AS (SELECT *, {PART_SQL} AS part FROM (SELECT *, min(epoch_us(ts)) OVER () AS lo, max(epoch_us(ts)) OVER () AS hi FROM articles) p)"


def event_stream(spark, sf_dir) -> DataFrame:
    """The events as files that arrive in three groups, each a third of the time span; one micro-batch per group."""
    ev = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = ev.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()
    part = F.floor(STREAM_PARTS * (micros - span["lo"]) / F.lit(span["hi"] - span["lo"] + 1.0))
    path = scratch_path(spark, "arrivals")
    for k in range(STREAM_PARTS):
        # The files of one third arrive together: each is written and read by tasks of its own.
        ev.where(part == k).repartition(FILES_A_BATCH).write.mode("append").parquet(path)
    return score_events(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(path))


ALL_DAYS = """all_days AS (SELECT entity, CAST(ts AS DATE) AS date, avg(composite_score) AS avg_composite, avg(positive_prob) AS avg_positive, avg(negative_prob) AS avg_negative,
  avg(neutral_prob) AS avg_neutral, count(composite_score) AS article_count, (avg(composite_score) + 1.0) / 2.0 AS scaled_sentiment FROM articles GROUP BY 1, 2)"""
DAY_SPEC = "entity:i date:d avg_composite:f avg_positive:f avg_negative:f avg_neutral:f article_count:i scaled_sentiment:f"


CLOSED = "SELECT * FROM all_days WHERE date + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query("daily_sentiment_stream", DAY_SPEC, CLOSED, [ARTICLES, ALL_DAYS])
def daily_stream(spark, sf_dir):
    """Append: a day is written once, when the watermark has passed it, and its state is released."""
    return drain(daily_sentiment_stream(event_stream(spark, sf_dir)), "daily-sentiment", "append")


@query("daily_sentiment_stream_complete", DAY_SPEC, "SELECT * FROM all_days", [ARTICLES, ALL_DAYS])
def daily_stream_complete(spark, sf_dir):
    return drain(daily_sentiment_stream(event_stream(spark, sf_dir)), "daily-sentiment-all", "complete")


@query("audit_micro_batches", "batch:i n:i max_sum_error:f sd_positive:f uniform_share:f failures:s",
       f"SELECT *, {BLOCK_FAILURES} AS failures FROM (SELECT part AS batch, {BLOCK_AGGS} FROM parts GROUP BY part) b", [ARTICLES, PARTS])
def audited_batches(spark, sf_dir):
    sink = scratch_path(spark, "batch-audit")
    audit_micro_batches(event_stream(spark, sf_dir), sink, scratch_path(spark, "batch-audit-progress")).awaitTermination()
    return spark.read.parquet(sink).withColumn("failures", F.concat_ws(",", "failures"))


@query("audit_stream", "entity:i block:i n:i max_sum_error:f sd_positive:f uniform_share:f failures:s late:i",
       f"""SELECT *, {BLOCK_FAILURES} AS failures, 0 AS late FROM (SELECT entity, idx // {STREAM_BLOCK} AS block, {BLOCK_AGGS} FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, article_id) - 1 AS idx FROM articles) a GROUP BY 1, 2) b""", [ARTICLES])
def audited_stream(spark, sf_dir):
    """Blocks that begin in one micro-batch and end in a later one: the same blocks as of the whole table."""
    sink = scratch_path(spark, "stream-audit")
    audit_stream(event_stream(spark, sf_dir), sink, scratch_path(spark, "stream-audit-progress"), block=STREAM_BLOCK).awaitTermination()
    return latest_blocks(spark.read.parquet(sink)).drop("closed", "upto").withColumn("failures", F.concat_ws(",", "failures"))
