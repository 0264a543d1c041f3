"""Positions, costs and the one-pass backtest against a plain loop."""

import numpy as np
import pandas as pd
import pytest

from barweave.operators import portfolio as pf


def loop(pred, actual, n, bps, charge_unwind=True):
    t_rows, names = pred.shape
    prev, out = np.zeros(names), []
    for t in range(t_rows):
        w, known = np.zeros(names), np.flatnonzero(~np.isnan(pred[t]))
        if len(known) >= 2 * n:
            order = known[np.argsort(pred[t][known], kind="stable")]
            w[order[-n:]], w[order[:n]] = 1 / n, -1 / n
        moved = np.abs(w - prev).sum()
        live = w.any() or (charge_unwind and moved > 0)
        gross = np.nansum(w * np.nan_to_num(actual[t])) if live else np.nan
        out.append((gross, moved if live else 0.0, gross - bps / 1e4 * moved))
        prev = w
    return np.array(out, dtype=float)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    dates = pd.date_range("2020-01-01", periods=25)
    pred, actual = rng.normal(size=(25, 30)), rng.normal(size=(25, 30)) / 50
    pred[rng.random((25, 30)) < 0.2] = np.nan
    pred[7], pred[15, :26], pred[24] = np.nan, np.nan, np.nan
    actual[rng.random((25, 30)) < 0.1] = np.nan
    rows = [("c", d.date(), e, None if np.isnan(pred[i, e]) else float(pred[i, e]), None if np.isnan(actual[i, e]) else float(actual[i, e]))
            for i, d in enumerate(dates) for e in range(30)]
    df = spark.createDataFrame(rows, "cell string, date date, entity int, pred double, actual double")
    return df, pred, actual


@pytest.mark.parametrize("charge", [True, False])
@pytest.mark.parametrize("n", [3, 8])
def test_backtest(panel, n, charge):
    df, pred, actual = panel
    want = loop(pred, actual, n, 20.0, charge)
    one = pf.backtest(df, ["cell"], [3, 8], charge_unwind=charge).where(f"top_n = {n}").orderBy("row_idx").toPandas()
    two = pf.portfolio_returns(pf.positions(df, ["cell"], [3, 8]), pf.panel_rows(df, ["cell"]), ["cell"], [3, 8], charge_unwind=charge)
    two = two.where(f"top_n = {n}").orderBy("row_idx").toPandas()
    for got in (one, two):
        assert len(got) == 25
        assert np.allclose(got[["gross", "turnover", "net"]].to_numpy(dtype=float), want, equal_nan=True)


def test_salts_do_not_change_ranks(panel):
    df = panel[0]
    key = ["date", "entity", "rank_low", "rank_high", "n_valid"]
    a, b = (pf.cross_section_rank(df, ["cell"], 4, salts=s).select(*key).toPandas().sort_values(key).values.tolist() for s in (1, 16))
    assert a == b


def test_select_topn(spark):
    rows = [("a", 3, 1.0), ("a", 5, 2.0), ("a", 7, 2.0), ("b", 3, None), ("b", 5, None), ("b", 7, None)]
    got = pf.select_topn(spark.createDataFrame(rows, "k string, top_n int, sharpe double"), ["k"], [3, 5, 7]).toPandas()
    assert dict(zip(got.k, got.top_n)) == {"a": 5, "b": 5}


def test_modes_and_rebalance_basis(panel):
    df = panel[0]
    long_only = pf.positions(df, ["cell"], [3], "long_only")
    assert long_only.where("weight < 0").count() == 0
    with pytest.raises(ValueError):
        pf.positions(df, ["cell"], [3], "sideways")
    moves = lambda basis: [r.turnover for r in pf.backtest(df, ["cell"], [3], basis=basis).orderBy("row_idx").collect()]
    assert moves(1) != moves(5)
