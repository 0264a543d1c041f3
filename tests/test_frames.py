"""Trailing frames of any length against pandas, with bad bars that must stay local."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import features as ft
from barweave.operators.frames import blocks
from barweave.plans.registry import rounded


def test_blocks_cover_a_frame():
    for d in range(1, 200):
        parts = blocks(d)
        assert sum(1 << k for k, _ in parts) == d
        assert sorted(r for k, back in parts for r in range(back, back + (1 << k))) == list(range(d))


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(6)
    n = 260
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    close[100:115] = close[100]  # ties and a constant stretch
    volume = np.round(np.exp(rng.normal(12, 1, n)))
    frame = pd.DataFrame({"entity": "a", "date": pd.date_range("2020-01-01", periods=n).date, "close": close, "high": close * 1.01, "low": close * 0.99,
                          "open": close, "volume": volume, "scaled_sentiment": rng.random(n)})
    return pd.concat([frame, frame[:7].assign(entity="b")], ignore_index=True)


def expected(g, d):
    c, v, s = g.close.astype(float), np.maximum(g.volume, 1.0), g.scaled_sentiment
    r, lv = np.log(c / c.shift()), np.log(v)
    dlv = lv.diff()
    x, y = r.where(dlv.notna()), dlv.where(r.notna())
    full = c.rolling(d).count() == d
    corr = pd.Series([np.corrcoef(x[i - d + 1:i + 1], y[i - d + 1:i + 1])[0, 1] if i >= d and x[i - d + 1:i + 1].std(ddof=0) > 1e-12 and x[
        i - d + 1:i + 1].notna().all() else np.nan for i in range(len(g))], index=g.index)
    return {f"MA_{d}": c / (c.rolling(d).mean() + 1e-9) - 1, f"STD_{d}": r.rolling(d).std(), f"MAX_{d}": (c.rolling(d).max() / (c + 1e-9) - 1).where(full),
            f"MIN_{d}": (c.rolling(d).min() / (c + 1e-9) - 1).where(full), f"HL_{d}": ((g.high.rolling(d).max() - g.low.rolling(d).min()) / (c + 1e-9)).where(full),
            f"RANK_{d}": c.rolling(d).rank(pct=True), f"VMA_{d}": v / (v.rolling(d).mean() + 1e-9) - 1, f"VSTD_{d}": lv.rolling(d).std(),
            f"SENT_MA_{d}": s.rolling(d).mean() - 0.5, f"SENT_STD_{d}": s.rolling(d).std(), f"CORR_{d}": corr}


@pytest.mark.parametrize("d", [3, 7, 13, 60])
def test_frames_equal_pandas_and_bad_bars_stay_local(spark, walk, d):
    names = [f"{f}_{d}" for f in ("MA", "STD", "MAX", "MIN", "HL", "RANK", "VMA", "VSTD", "SENT_MA", "SENT_STD", "CORR")]
    clean = ft.rolling(spark.createDataFrame(walk).repartition(3), names).toPandas().sort_values(["entity", "date"]).reset_index(drop=True)
    for _, g in clean.groupby("entity"):
        for name, want in expected(g, d).items():
            got = g[name].astype(float)
            assert (got.isna() == want.isna()).all(), name
            assert np.allclose(got.dropna(), want.dropna(), rtol=1e-7, atol=1e-9), name
    odd = walk.copy()
    odd.loc[130, "close"], odd.loc[131, "volume"], odd.loc[132, "scaled_sentiment"], odd.loc[133, "close"] = 1e12, 1e300, np.nan, np.inf
    broken = ft.rolling(spark.createDataFrame(odd).repartition(3), names).toPandas().sort_values(["entity", "date"]).reset_index(drop=True)
    far = np.r_[0:130, 133 + d + 1:len(walk)]
    for name in names:
        assert np.allclose(broken.loc[far, name].astype(float), clean.loc[far, name].astype(float), rtol=1e-9, atol=1e-12, equal_nan=True), name


def test_wide_rows_are_sorted_once_and_entities_span_batches(spark, walk):
    bars = spark.createDataFrame(walk).withColumn("adj_close", F.lit(None).cast("double"))
    plan = ft.prepared_bars(bars, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Window" not in plan
    whole = ft.prepared_bars(bars, 5).toPandas().sort_values(["entity", "date"]).reset_index(drop=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        cut = ft.prepared_bars(bars, 5).toPandas().sort_values(["entity", "date"]).reset_index(drop=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pd.testing.assert_frame_equal(whole, cut)
    plain = ft.complete_rows(ft.alpha_features(ft.adjust_ohlc(bars)), ft.feature_names(), 5)
    assert len(whole) == plain.count() > 100 and ft.prepared_bars(bars, len(whole) + 1).count() == 0


def test_rounding_is_that_of_round(spark):
    values = [0.1234565, -0.1234565, 0.0078125, 2.5e-7, -4e-7, 1e300, -1e13 - 0.5, 123456.7890125, float("nan"), float("inf"), float("-inf"), None, 0.0, -0.0]
    values += np.random.default_rng(1).normal(0, 10, 2000).tolist() + [k / 2e6 for k in range(-501, 501)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x")).alias("a"), F.round("x", 6).alias("b"))
    assert got.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()
