"""Scores of probabilistic predictions: likelihood, volatility error, gated Sharpe, gate calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.functions.maths import bounded
from barweave.operators.ordering import range_ranks
from barweave.operators.signals import LOG_VAR_HIGH, LOG_VAR_LOW, gate, position, sigma_of

# Floors of the training-time scores.
EPS_SHARPE = 1e-3
GATE_EDGE = 1e-6


def with_risk_columns(df: DataFrame, alpha: float = 10.0, temperature: float = 1.0, tau_vol=0.0, tau_sigma=0.0) -> DataFrame:
    """Add sigma, position and gate from mu, log_sigma2 and log_vol."""
    out = df.withColumn("sigma", sigma_of())
    return out.withColumns({
        "position": position("mu", "sigma", alpha), "gate": gate("log_vol", "log_sigma2", temperature, tau_vol, tau_sigma)})


def gated_sharpe_of(ret: Column) -> Column:
    return F.avg(ret) / (F.stddev_pop(ret) + EPS_SHARPE)


def risk_scores(df: DataFrame, keys: list[str], target: str = "actual", vol_target: str = "log_vol_target") -> DataFrame:
    """Gaussian NLL, return MSE, log-vol MSE and Sharpe of gate x position x return in one aggregation."""
    y, mu = F.col(target), F.col("mu")
    lv = bounded("log_sigma2", LOG_VAR_LOW, LOG_VAR_HIGH)
    nll = 0.5 * (lv + (y - mu) * (y - mu) / F.exp(lv))
    vol_error = F.col("log_vol") - F.col(vol_target)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(nll).alias("gaussian_nll"),
        F.avg((mu - y) * (mu - y)).alias("return_mse"), F.avg(vol_error * vol_error).alias("vol_mse"),
        gated_sharpe_of(F.col("gate") * F.col("position") * y).alias("gated_sharpe"))


def group_sharpe(df: DataFrame, n_groups: int = 8, seed: int = 42, ids: list[str] = ["entity", "date"],
                 target: str = "actual", keys: list[str] = []) -> DataFrame:
    """Rows fall into ``n_groups`` pseudo-random cross-sections; each leg is normalised inside its group.

    Groups come from a hash of (seed, ids). Leg normalisation divides after summing, so a group is
    reduced to four sums by partial aggregation and is never gathered.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n_groups
    raw = F.col("position") * F.col("gate")
    up, down = F.greatest(raw, F.lit(0.0)), F.greatest(-raw, F.lit(0.0))
    known = df.where(raw.isNotNull() & F.col(target).isNotNull())
    sums = known.groupBy(*keys, bucket.alias("group")).agg(
        F.sum(up).alias("_u"), F.sum(down).alias("_d"),
        F.sum(up * F.col(target)).alias("_ur"), F.sum(down * F.col(target)).alias("_dr"))
    port = F.col("_ur") / (F.col("_u") + 1e-9) - F.col("_dr") / (F.col("_d") + 1e-9)
    return sums.withColumn("_p", port).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"), gated_sharpe_of(F.col("_p")).alias("group_sharpe"))


def margin_bce(df: DataFrame, keys: list[str], use_margin: bool = True, target: str = "actual") -> DataFrame:
    """Cross-entropy of the gate against 1{position x return > 0}.

    With ``use_margin`` only rows whose |position x return| reaches the (lower) median count.
    """
    rows = df.withColumn("_pnl", F.col("position") * F.col(target)).where(F.col("_pnl").isNotNull())
    rows = rows.groupBy(*keys, "_pnl", "gate").agg(F.count(F.lit(1)).alias("_rows"))
    g = bounded("gate", GATE_EDGE, 1.0 - GATE_EDGE)
    loss = -F.when(F.col("_pnl") > 0, F.ln(g)).otherwise(F.ln(1.0 - g))
    if use_margin:
        ranked = range_ranks(rows.withColumn("_abs", F.abs("_pnl")), keys, "_abs", "_rows", ties=["gate"])
        rows = ranked.where(F.col("n_less") + F.col("n_eq") > F.floor((F.col("n_total") - 1) / 2))
    scored = rows.withColumn("_loss", loss)
    mean = F.sum(F.col("_loss") * F.col("_rows")) / F.sum(F.when(F.col("_loss").isNotNull(), F.col("_rows")))
    return scored.groupBy(*keys).agg(F.sum("_rows").alias("n"), mean.alias("margin_bce"))
