"""Parameter-free ranking signals and model-output transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.functions.maths import as_col, at_least, bounded, safe_div, sigmoid
from barweave.operators.features import by_entity
from barweave.operators.splits import Fold, apply_scaler, fit_scaler, purged_split, sample_index

# Look-back rows of the momentum, reversal and mid-term legs, and the tilt weights.
NEAR, FAR, SHORT, MID = 21, 252, 5, 60
TILT = {"momentum": 1.0, "day": -0.3, "mid": 0.5, "extra": 0.2}
STRATEGIES = ["xs_momentum", "xs_reversal", "ridge_alpha"]


def lag_table(bars: DataFrame, length: int, entity: str = "entity", date: str = "date") -> DataFrame:
    """Closes the signals look back on, capped at the start of a ``length``-row window."""
    w = by_entity(entity, date)
    back = {"_near": NEAR, "_far": FAR, "_short": SHORT, "_mid": MID, "_prev": 2}
    return bars.withColumns({n: F.lag("close", min(k, length) - 1).over(w) for n, k in back.items()})


def signal_column(strategy: str, sd="sd_close", extra=None) -> Column:
    """Signal on z-scored closes: the scaler's mean cancels, so raw differences over its deviation suffice."""
    sd = as_col(sd)
    momentum = (F.col("_near") - F.col("_far")) / sd
    if strategy == "xs_momentum":
        return momentum
    if strategy == "xs_reversal":
        return -(F.col("close") - F.col("_short")) / sd
    if strategy == "ridge_alpha":
        day = (F.col("close") - F.col("_prev")) / sd
        mid = (F.col("close") - F.col("_mid")) / sd
        tilt = F.lit(0.0) if extra is None else as_col(extra)
        return TILT["momentum"] * momentum + TILT["day"] * day + TILT["mid"] * mid + TILT["extra"] * tilt
    raise ValueError(f"unknown strategy: {strategy!r}")


def signal(df: DataFrame, strategy: str, length: int = 504, sent_col: str | None = None, close: str = "close",
           out: str = "signal", entity: str = "entity", date: str = "date") -> DataFrame:
    """Signal of an already z-scored close column per (entity, date)."""
    lagged = lag_table(df.withColumn("_c", F.col(close)).drop("close").withColumnRenamed("_c", "close"), length, entity, date)
    value = signal_column(strategy, F.lit(1.0), sent_col)
    return lagged.withColumn(out, value).select(*[c for c in df.columns if c != out], out)


def collect_signals(bars: DataFrame, folds: list[Fold], length: int, horizons: list[int], strategies: list[str],
                    sent_col: str | None = None, embargo: int | None = None, entity: str = "entity",
                    date: str = "date") -> DataFrame:
    """Signal and realised log return of every val/test sample for all strategies, horizons and folds.

    Lags, scaler and targets come from one exchange and one sort of the bars. Fold labels and strategies are
    map-side expansions of the (filtered) anchors, so nothing is windowed once per cell and nothing is joined.
    """
    cols = ["close"] + ([sent_col] if sent_col else [])
    lagged = lag_table(bars.select(entity, date, *cols), length, entity, date)
    anchors = sample_index(fit_scaler(lagged, folds, cols, entity, date, beside=True), length, horizons, entity, date)
    if embargo is None or embargo >= 0:  # val and test anchors begin where the first validation does
        anchors = anchors.where(F.col(date) >= F.lit(min(min(f.val_start, f.test_start) for f in folds)))
    labelled = purged_split(anchors, folds, embargo, date=date).where(F.col("split").isin("val", "test"))
    scaled = apply_scaler(labelled, folds, cols, [entity, "fold"])
    extra = f"z_{sent_col}" if sent_col else None
    rows = F.array(*[
        F.struct(F.lit(s).alias("strategy"), signal_column(s, "sd_close", extra).alias("pred")) for s in strategies])
    return scaled.withColumn("_s", F.explode(rows)).select(
        "_s.strategy", "horizon", "fold", "split", F.col(date).alias("date"), F.col(entity).alias("entity"),
        "_s.pred", F.col("y_logret").alias("actual"))


# ---- model outputs -----------------------------------------------------------

LOG_VAR_LOW, LOG_VAR_HIGH = -12.0, 4.0


def sigma_of(log_sigma2="log_sigma2") -> Column:
    return F.exp(0.5 * bounded(log_sigma2, LOG_VAR_LOW, LOG_VAR_HIGH))


def gate(log_vol="log_vol", log_sigma2="log_sigma2", temperature: float = 0.13, tau_vol=0.0, tau_sigma=0.0,
         s_vol: float = 1.0, s_sigma: float = 1.0) -> Column:
    """Confidence in (0, 1): low predicted volatility and low predicted variance."""
    tv, ts = (t if isinstance(t, Column) else F.lit(float(t)) for t in (tau_vol, tau_sigma))
    by_vol = sigmoid((tv - as_col(log_vol)) / (s_vol * temperature))
    by_sigma = sigmoid((ts - sigma_of(log_sigma2)) / (s_sigma * temperature))
    return by_vol * by_sigma


def position(mu="mu", sigma=None, alpha: float = 10.0, inference: bool = False) -> Column:
    """Saturating size: alpha·mu/(sigma + 1e-3) in training, mu/max(sigma, 1e-3) at inference."""
    sigma = sigma_of() if sigma is None else as_col(sigma)
    den = at_least(sigma, 1e-3) if inference else sigma + 1e-3
    return F.tanh(alpha * as_col(mu) / den)


def to_returns(df: DataFrame, pred: str, actual: str, last: str, lo: str, hi: str) -> DataFrame:
    """Undo min-max scaling of three closes and turn prediction and truth into simple returns."""
    raw = lambda c: F.col(c) * (F.col(hi) - F.col(lo)) + F.col(lo)
    base = at_least(raw(last), 1e-9)
    return df.withColumns({
        "pred_return": (raw(pred) - raw(last)) / base, "actual_return": (raw(actual) - raw(last)) / base})


def prediction_table(bars: DataFrame, mu: Column, span: int = 20, entity: str = "entity", date: str = "date") -> DataFrame:
    """Stand-in model output from bars: mu, log variance of the last ``span`` log returns, half of it as log vol."""
    w = by_entity(entity, date)
    step = bars.withColumn("_r", F.ln(safe_div(F.col("close"), F.lag("close").over(w))))
    held = w.rowsBetween(-(span - 1), 0)
    out = step.withColumn("mu", mu).withColumn("log_sigma2", F.when(
        F.count("_r").over(held) == span, F.ln(F.var_pop("_r").over(held) + 1e-6)))
    return out.withColumn("log_vol", 0.5 * F.col("log_sigma2")).drop("_r")
