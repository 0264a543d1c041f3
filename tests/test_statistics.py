"""Properties of the statistics, plus stored results recomputed from their return series."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions import norm_cdf, norm_ppf
from barweave.operators import bootstrap as bs
from barweave.operators import inference as inf
from barweave.operators import metrics as mt

# 48 net returns of a stored momentum run (5-row horizon, 20 bps).
STORED = [
    0.026402739612159755, -0.0011126143076395738, -0.03313303080345082, -0.09451745711110424, 0.039631671248196006,
    -0.007738894903310653, 0.09468131645354712, 0.043595295576369285, -0.08034340054307762, 0.1010518438169071,
    0.001562196680775638, -0.1151767163297261, 0.02445112981032922, 0.061853029436713516, 0.031597177518254874,
    -0.006815863170522248, 0.029433319415922497, 0.0016358873977966072, 0.0016106398955702493, 0.1281597359652867,
    -0.02757572157209795, 0.006820589889179058, 0.007229409908083098, -0.0058393819821940625, 0.0027666396215716062,
    0.04022278398673082, -0.0899291165630647, -0.04776505043400229, 0.013806088680725675, 0.023467642983096358,
    0.0007972638587566752, 0.04071149493168581, -0.042548307088723876, 0.036447899491528386, -0.03126263133785287,
    0.019264624445898527, 0.05847389051802403, 0.05663294493148199, -0.04710273596579031, 0.09641645798010426,
    0.002093801039702946, 0.016080574246947386, -0.01889235854694269, 0.04048704954424466, 0.0030238119110318745,
    -0.033474799610846304, -0.0771569094619994, 0.04306487322086604,
]


def series(spark, values, **extra):
    return spark.createDataFrame(pd.DataFrame({"cell": "c", "row_idx": range(len(values)), "net": values, **extra}))


def test_stored_results(spark):
    row = mt.perf_metrics(series(spark, STORED), ["cell"], 5).first()
    assert math.isclose(row.sharpe, 0.9640848728437319, rel_tol=1e-12)
    assert math.isclose(row.mdd, 0.1333986982089469, rel_tol=1e-12)
    assert math.isclose(row.cumulative_return, 0.3110769440717269, rel_tol=1e-12)
    assert row.n_obs == 48 and row.inference_valid


def test_metric_edges(spark):
    one = mt.perf_metrics(series(spark, [-0.5]), ["cell"], 5).first()
    assert one.sharpe is None and one.mdd == 0.0
    up = mt.perf_metrics(series(spark, [0.1, 0.2, 0.3]), ["cell"], 5).first()
    assert up.sortino == float("inf") and up.calmar is None
    flat = mt.perf_metrics(series(spark, [0.1, 0.1, 0.1]), ["cell"], 5).first()
    assert flat.sharpe is None


def test_normal_functions(spark):
    z = np.linspace(-9, 9, 181)
    p = np.concatenate([np.logspace(-12, -1, 40), np.linspace(0.1, 0.9, 40), [1 - 1e-9]])
    got = spark.createDataFrame(pd.DataFrame({"z": z})).select(norm_cdf("z").alias("v")).toPandas().v
    assert np.allclose(got, [NormalDist().cdf(v) for v in z], atol=1e-15)
    got = spark.createDataFrame(pd.DataFrame({"p": p})).select(norm_ppf("p").alias("v")).toPandas().v
    assert np.allclose(got, [NormalDist().inv_cdf(v) for v in p], rtol=1e-12)
    edge = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(norm_ppf("p").alias("v")).collect()
    assert all(r.v is None for r in edge)


def hac(x, lag):
    """Long-run standard error as a quadratic form: deviations around a Bartlett matrix of weights."""
    place = np.arange(len(x))
    bartlett = np.clip(1 - np.abs(np.subtract.outer(place, place)) / (lag + 1), 0, None)
    dev = x - np.mean(x)
    return math.sqrt(dev @ bartlett @ dev) / len(x)


def test_newey_west(spark):
    rng = np.random.default_rng(1)
    x = np.zeros(500)
    for i in range(1, 500):
        x[i] = 0.7 * x[i - 1] + rng.normal()
    df = series(spark, x).withColumnRenamed("net", "ic")
    plain = inf.newey_west(df, ["cell"], "ic", 0).first().nw_se
    wide = inf.newey_west(df, ["cell"], "ic", 10).first().nw_se
    assert math.isclose(plain, x.std() / math.sqrt(500), rel_tol=1e-9)
    assert math.isclose(wide, hac(x, 10), rel_tol=1e-9) and wide > 1.5 * plain
    assert inf.newey_west(df.limit(1), ["cell"], "ic", 3).first().nw_se is None


def test_moments_and_deflated_sharpe(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0.02, 0.1, 60)
    df = series(spark, r, horizon=5)
    m = mt.moments(df, ["cell"]).first()
    sd = r.std(ddof=1)
    assert math.isclose(m.skew, ((r - r.mean()) ** 3).mean() / sd**3, rel_tol=1e-9)
    assert math.isclose(m.kurt, ((r - r.mean()) ** 4).mean() / sd**4, rel_tol=1e-9)

    def dsr(n_trials):
        trials = spark.createDataFrame(pd.DataFrame({"sharpe": rng.normal(0, 0.5, n_trials)}))
        return inf.deflated_sharpe(df, trials, ["cell"]).first()

    few, many = dsr(5), dsr(500)
    assert 0 < many.dsr < few.dsr < 1 and many.sr_zero > few.sr_zero


def test_bootstrap_is_reproducible(spark):
    df = series(spark, STORED, horizon=5)
    a = bs.sharpe_ci(df, ["cell"], 200).first()
    b = bs.sharpe_ci(df.repartition(7), ["cell"], 200).first()
    assert math.isclose(a.sharpe_lo, b.sharpe_lo) and a.sharpe_lo < a.point_net < a.sharpe_hi
    assert a.status == "ok"
    short = bs.sharpe_ci(df.where("row_idx < 5"), ["cell"], 50).first()
    assert short.status == "refused" and short.sharpe_lo is None
    picks = bs.resample(bs.with_block(bs.indexed(df, ["cell"], ["net"]), 4.0), ["cell"], 50, 7)
    moves = picks.toPandas().sort_values(["rep", "i"])
    step = (moves.pick - moves.groupby("rep").pick.shift()) % 48
    assert moves.pick.between(0, 47).all() and 0.65 < (step == 1).mean() < 0.85


def test_holm_and_bh(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame(pd.DataFrame({"hypothesis": list("abcd"), "p_value": p}))
    got = inf.multiple_testing(df, []).orderBy("hypothesis").toPandas()
    assert np.allclose(got.p_holm, [0.03, 0.06, 0.06, 0.02]) and np.allclose(got.p_bh, [0.02, 0.04, 0.04, 0.02])


@pytest.mark.parametrize("level", [0.0, 100.0, 1e4, 1e6])
def test_regression_corr(spark, level):
    """The same deviations at any level of the values, and on very different scales."""
    rng = np.random.default_rng(4)
    for scale in (1.0, 0.05):
        t, p = rng.normal(size=50) + level, scale * rng.normal(size=50) + level
        got = mt.regression_metrics(spark.createDataFrame(pd.DataFrame({"k": 1, "actual": t, "pred": p})), ["k"]).first()
        u, v = t - t.mean(), p - p.mean()
        assert math.isclose(got["corr"], (u * v).sum() / math.sqrt((u**2 * v**2).sum()), rel_tol=1e-6 if level else 1e-9)
        assert math.isclose(got.r2, 1 - ((t - p) ** 2).sum() / (u**2).sum(), rel_tol=1e-6)
    flat = mt.regression_metrics(spark.createDataFrame([(1, 2.0, level), (1, 2.0, level + 1)], "k int, actual double, pred double"), ["k"]).first()
    assert flat["corr"] is None and flat.n == 2