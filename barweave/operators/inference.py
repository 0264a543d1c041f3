"""Rank information coefficients, HAC errors, multiple testing and deflated Sharpe."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.maths import TINY, as_col, norm_cdf, norm_ppf, safe_div
from barweave.operators.features import TRADING_DAYS
from barweave.operators.metrics import moments, periods
from barweave.operators.ordering import range_ranks
from barweave.session import stored

EULER_GAMMA = 0.5772156649015329  # fixed value


def paired_values(panel: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Distinct (x, y) pairs with multiplicity; ties collapse before anything is ranked."""
    known = panel.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(*group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(
        F.count(F.lit(1)).alias("w"))


def ranked_pairs(panel: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Pairs with ``{c}_less``, ``{c}_eq`` and ``{c}_bucket`` for both sides, and the group size ``n``.

    Both sides are ranked by one range exchange over (group, side, value); a second exchange brings a pair's two ranks together.
    """
    pairs = paired_values(panel, group, x, y)
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("value")) for c in "xy"])
    stacked = pairs.select(*group, "x", "y", "w", F.explode(sides).alias("_s")).select(*group, "x", "y", "w", "_s.*")
    ranked = range_ranks(stacked, [*group, "side"], "value", "w", ties=["x", "y"])
    of = lambda c, what: F.max(F.when(F.col("side") == c, F.col(what)))
    return ranked.groupBy(*group, "x", "y").agg(
        F.max("w").alias("w"), F.max("n_total").alias("n"), *[of(c, f).alias(f"{c}_{g}") for c in "xy" for f, g in (
            ("n_less", "less"), ("n_eq", "eq"), ("bucket", "bucket"))])


def spearman_ic(panel: DataFrame, group: list[str], x: str = "pred", y: str = "actual", min_pairs: int = 5) -> DataFrame:
    """Spearman correlation per group from exact average ranks.

    Sums run over rank deviations (the mean rank is known to be (n+1)/2), so one
    aggregation is enough and no group is gathered for sorting.
    """
    ranked = ranked_pairs(panel, group, x, y)
    w = F.col("w").cast("double")
    centre = lambda c: F.col(f"{c}_less") + (F.col(f"{c}_eq") + 1) / 2.0
    sums = ranked.withColumns({"_a": centre("x"), "_b": centre("y")}).groupBy(*group).agg(
        F.sum("w").alias("n"), F.sum(w * F.col("_a") * F.col("_b")).alias("_ab"),
        F.sum(w * F.col("_a") * F.col("_a")).alias("_aa"), F.sum(w * F.col("_b") * F.col("_b")).alias("_bb"))
    mean = (F.col("n") + 1) / 2.0
    cov, va, vb = (F.col(c) - F.col("n") * mean * mean for c in ("_ab", "_aa", "_bb"))
    return sums.where(F.col("n") >= min_pairs).select(*group, "n", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("ic"))


def kendall_ic(panel: DataFrame, group: list[str], x: str = "pred", y: str = "actual", min_pairs: int = 5) -> DataFrame:
    """Kendall tau-b per group in n log n rows, without forming pairs.

    A discordant pair has x in order and y out of order. Writing the y rank in binary, the two ranks
    first differ at one bit: the earlier row has it set, the later one has not. Per bit level and shared
    prefix it is therefore enough to count set bits at strictly smaller x. The count is a running sum over
    x, split by the x buckets of the ranking so that the top level is not a single task.
    """
    ranked = ranked_pairs(panel, group, x, y).where(F.col("n") >= min_pairs)
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("n") + 1)).cast("int"))
    rows = ranked.select(*group, "n", "x_less", "x_bucket", "y_less", "w", F.explode(levels).alias("level"))
    shifted = F.col("y_less") / F.pow(F.lit(2.0), F.col("level"))
    digit = F.floor(shifted)
    rows = rows.withColumns({"prefix": F.floor(digit / 2), "bit": digit % 2})
    cell = [*group, "level", "prefix"]
    by_bucket = Window.partitionBy(*cell).orderBy("x_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ones = F.when(F.col("bit") == 1, F.col("w")).otherwise(0)
    carried = rows.groupBy(*cell, "x_bucket").agg(F.sum(ones).alias("_o")).select(
        *cell, "x_bucket", F.coalesce(F.sum("_o").over(by_bucket), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*cell, "x_bucket").orderBy("x_less").rangeBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(ones).over(inside), F.lit(0))).where(F.col("bit") == 0)
    discordant = local.join(carried, [*cell, "x_bucket"]).groupBy(*group).agg(
        F.sum(F.col("w") * (F.col("_carry") + F.col("_local"))).cast("double").alias("_d"))

    # Tie counts: summing (t - 1)/2 over the t rows of a tie gives its t(t - 1)/2 pairs.
    pairs_of = lambda c: c * (c - 1) / 2.0
    both = ranked.groupBy(*group).agg(
        F.max("n").alias("n"), F.sum(pairs_of(F.col("w"))).alias("_xyt"),
        F.sum(F.col("w") * (F.col("x_eq") - 1) / 2.0).alias("_xt"), F.sum(F.col("w") * (F.col("y_eq") - 1) / 2.0).alias("_yt"))
    out = both.join(discordant, group, "left")
    total, d = pairs_of(F.col("n")), F.coalesce(F.col("_d"), F.lit(0.0))
    agree = total - F.col("_xt") - F.col("_yt") + F.col("_xyt") - d
    base = (total - F.col("_xt")) * (total - F.col("_yt"))
    return out.select(*group, "n", F.when(base > 0, (agree - d) / F.sqrt(base)).alias("ic"))


def rank_ic(panel: DataFrame, keys: list[str], method: str = "spearman", min_pairs: int = 5, x: str = "pred",
            y: str = "actual", date: str = "date") -> DataFrame:
    by = {"spearman": spearman_ic, "kendall": kendall_ic}[method]
    return by(panel, [*keys, date], x, y, min_pairs)


def ic_series(panel: DataFrame, ic: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """IC with its panel row number; dates without an IC keep a NULL row."""
    return rows.join(ic, [*keys, "date"], "left")


def ic_hit_rate(ic: DataFrame, keys: list[str]) -> DataFrame:
    return ic.where(F.col("ic").isNotNull()).groupBy(*keys).agg(F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"))


def icir_daily(ic: DataFrame, keys: list[str]) -> DataFrame:
    sd = F.stddev_samp("ic")
    return ic.groupBy(*keys).agg(F.count("ic").alias("n"), F.when(
        (F.count("ic") >= 2) & (sd > TINY), F.avg("ic") / sd * math.sqrt(TRADING_DAYS)).alias("icir_daily"))


def val_rank_ic(panel: DataFrame, keys: list[str], min_pairs: int = 5, x: str = "pred", y: str = "actual",
                date: str = "date") -> DataFrame:
    """Mean daily Spearman; flat days are skipped; 0 when no day qualifies."""
    panel = stored(panel.select(*keys, date, x, y), "panel")
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = stored(panel.groupBy(*keys, date).agg(
        F.stddev_pop(F.when(both, F.col(x))).alias("_sx"), F.stddev_pop(F.when(both, F.col(y))).alias("_sy")), "spread")
    usable = spread.where((F.col("_sx") >= TINY) & (F.col("_sy") >= TINY)).select(*keys, date)
    daily = rank_ic(panel, keys, "spearman", min_pairs, x, y, date).join(usable, [*keys, date], "left_semi")
    mean = daily.groupBy(*keys).agg(F.avg("ic").alias("m"), F.count("ic").alias("n_days"))
    return spread.select(*keys).distinct().join(mean, keys, "left").select(
        *keys, F.coalesce("n_days", F.lit(0)).alias("n_days"), F.coalesce("m", F.lit(0.0)).alias("val_rank_ic"))


# ---- serial correlation ------------------------------------------------------

def lag_pairs(ts: DataFrame, keys: list[str], idx: str, col: str, max_lag: Column | int, circular: bool = False) -> DataFrame:
    """(x_t, x_(t-k)) for k = 1..max_lag. ``idx`` counts the rows of a key without gaps; ``max_lag`` may depend on the keys.

    A key's series, one value per date, travels once as a sorted list; pairs are made from slices of it, so the exchange
    carries rows, not rows x lags. ``circular`` continues a series at its start.
    """
    lists = ts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(col).alias("x")))).alias("_s"))
    top = F.lit(max_lag) if isinstance(max_lag, int) else max_lag
    lists = lists.select(*keys, F.transform("_s", lambda s: s["x"]).alias("_x"), F.least(top.cast("int"), F.size("_s") - 1).alias("_top"))
    lags = lists.where(F.col("_top") >= 1).withColumn("lag", F.explode(F.sequence(F.lit(1), F.col("_top"))))
    rest = F.size("_x") - F.col("lag")
    late, early = F.slice("_x", F.col("lag") + 1, rest), F.slice("_x", F.lit(1), rest)
    if circular:
        late, early = F.concat(late, F.slice("_x", F.lit(1), F.col("lag"))), F.col("_x")
    return lags.select(*keys, "lag", F.explode(F.arrays_zip(late.alias("x"), early.alias("x_lag"))).alias("_p")).select(
        *keys, "lag", F.col("_p.x"), F.col("_p.x_lag"))


def newey_west(ts: DataFrame, keys: list[str], col: str = "ic", lag: str | int = "nw_lag", order: str = "row_idx") -> DataFrame:
    """Bartlett-weighted standard error of the mean over the non-null values in ``order``.

    NULL for fewer than two values or a non-positive variance.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    known = ts.where(F.col(col).isNotNull()).withColumns({
        "_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole),
        "_x": F.col(col) - F.avg(col).over(whole), "_lag": F.col(lag) if isinstance(lag, str) else F.lit(lag)})
    base = known.groupBy(*keys).agg(F.first("_n").alias("n"), F.avg(F.col("_x") * F.col("_x")).alias("_g0"))
    reach = F.least(F.col("_lag"), F.col("_n") - 1)
    near = lag_pairs(known, [*keys, "_n", "_lag"], "_i", "_x", reach)
    weighted = 2.0 * (1.0 - F.col("lag") / (F.col("_lag") + 1.0)) * F.col("x") * F.col("x_lag") / F.col("_n")
    extra = near.groupBy(*keys).agg(F.sum(weighted).alias("_gk"))
    s = F.col("_g0") + F.coalesce(F.col("_gk"), F.lit(0.0))
    return base.join(extra, keys, "left").select(
        *keys, "n", F.when((F.col("n") >= 2) & (s > 0), F.sqrt(s / F.col("n"))).alias("nw_se"))


def ic_summary(ic_rows: DataFrame, keys: list[str], horizon: str | int = "horizon") -> DataFrame:
    """IC mean, deviation, annualised ratio, HAC error and t value on the non-overlapping rows."""
    h = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    grid = ic_rows.where(F.col("row_idx") % h == 0).withColumn("nw_lag", F.greatest(F.lit(0), h - 1))
    sd = F.stddev_samp("ic")
    base = grid.groupBy(*keys).agg(
        F.count("ic").alias("n_obs"), F.when(F.count("ic") >= 2, F.avg("ic")).alias("ic_mean"), sd.alias("ic_std"),
        F.when(sd > TINY, F.avg("ic") / sd * F.sqrt(F.first(periods(horizon)))).alias("icir"),
        F.first("nw_lag").alias("nw_lag"))
    se = newey_west(grid, keys, "ic", "nw_lag").drop("n")
    return base.join(se, keys, "left").withColumn(
        "nw_tstat", F.when(F.col("nw_se") > TINY, F.col("ic_mean") / F.col("nw_se")))


# ---- multiple testing ----------------------------------------------------------

def multiple_testing(df: DataFrame, keys: list[str], p: str = "p_value", tie: str = "hypothesis", level: float = 0.05) -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted p-values within each family of hypotheses.

    A family is one row per tested cell, so it stays as small as the experiment grid.
    """
    family = Window.partitionBy(*(keys or [F.lit(1)]))
    up = family.orderBy(p, tie)
    rows = df.where(F.col(p).isNotNull()).withColumns({
        "_k": F.row_number().over(up), "_n": F.count(F.lit(1)).over(family)})
    holm = F.least(F.col(p) * (F.col("_n") - F.col("_k") + 1), F.lit(1.0))
    bh = F.least(F.col(p) * F.col("_n") / F.col("_k"), F.lit(1.0))
    out = rows.withColumns({
        "p_holm": F.max(holm).over(up.rowsBetween(Window.unboundedPreceding, 0)),
        "p_bh": F.min(bh).over(up.rowsBetween(0, Window.unboundedFollowing))})
    return out.withColumns({
        "significant_holm": F.col("p_holm") < level, "significant_bh": F.col("p_bh") < level}).drop("_k", "_n")


# ---- deflated Sharpe -------------------------------------------------------------

def per_period_sharpe(ts: DataFrame, keys: list[str], ret: str = "net") -> DataFrame:
    sd = F.stddev_samp(ret)
    return ts.groupBy(*keys).agg(F.count(ret).alias("n_obs"), F.when(
        (F.count(ret) >= 2) & (sd >= TINY), F.avg(ret) / sd).alias("sr"))


def trial_variance(trials: DataFrame, keys: list[str], horizon: str | int = "horizon", sharpe: str = "sharpe") -> DataFrame:
    """Number of trials and sample variance of their per-period Sharpe ratios."""
    per_period = F.col(sharpe) / F.sqrt(periods(horizon))
    return trials.groupBy(*keys).agg(F.count(sharpe).alias("n_trials"), F.var_samp(per_period).alias("trial_var"))


def expected_max_sharpe(n, var) -> Column:
    """Expected best Sharpe among ``n`` skill-less trials; NULL for n < 2 or no variance."""
    n, var = as_col(n).cast("double"), as_col(var)
    blend = (1.0 - EULER_GAMMA) * norm_ppf(1.0 - 1.0 / n) + EULER_GAMMA * norm_ppf(1.0 - 1.0 / (n * math.e))
    return F.when((n >= 2) & (var > 0), F.sqrt(var) * blend)


def deflated_sharpe_column(sr, sr0, t, skew, kurt) -> Column:
    sr, sr0, t, skew, kurt = map(as_col, (sr, sr0, t, skew, kurt))
    den = 1.0 - skew * sr + (kurt - 1.0) / 4.0 * sr * sr
    return F.when((t >= 2) & (den > 0), norm_cdf((sr - sr0) * F.sqrt(t - 1.0) / F.sqrt(den)))


def deflated_sharpe(returns: DataFrame, trials: DataFrame, keys: list[str], trial_keys: list[str] | None = None,
                    horizon: str = "horizon", ret: str = "net", sharpe: str = "sharpe") -> DataFrame:
    """Probability that each cell's Sharpe beats the best of its trial pool by luck.

    ``trials`` (trial_keys, sharpe) are annualised; the cell's own horizon converts them per period.
    """
    shared = trial_keys or []
    cell = returns.groupBy(*keys).agg(F.first(horizon).alias("_h"))
    stats = moments(returns, keys, ret).join(cell, keys)
    pool = trials.groupBy(*shared).agg(F.count(sharpe).alias("n_trials"), F.var_samp(sharpe).alias("_va"))
    if shared:
        joined = stats.join(pool, shared, "left")
    else:
        one = pool.select(F.struct("n_trials", "_va")).scalar()
        joined = stats.withColumn("_pool", one).select("*", "_pool.n_trials", "_pool._va").drop("_pool")
    factor = periods("_h")
    sr = F.when((F.col("n_obs") >= 2) & (F.col("sd") >= TINY), F.col("mean") / F.col("sd"))
    out = joined.withColumn("sr", sr).withColumn("trial_var", F.col("_va") / factor)
    out = out.withColumn("sr_zero", expected_max_sharpe("n_trials", "trial_var"))
    return out.withColumn("dsr", deflated_sharpe_column("sr", "sr_zero", F.col("n_obs").cast("double"), "skew", "kurt")).withColumns({
        "sr_annualised": F.col("sr") * F.sqrt(factor), "sr_zero_annualised": F.col("sr_zero") * F.sqrt(factor),
        "significant": F.col("dsr") >= 0.95,
    }).drop("_h", "_va")


# How far a horizon's intervals can be trusted.
CI_TIERS = {5: "full", 20: "full", 60: "aggregate", 120: "point"}


def ci_tier(horizon, tiers: dict[int, str] = CI_TIERS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in tiers.items() for x in pair])
    return F.coalesce(F.element_at(table, as_col(horizon)), F.lit("unknown"))
