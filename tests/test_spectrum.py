"""Spectra and autocorrelations in n log n against their definitions."""

import numpy as np
import pandas as pd
import pytest

from barweave.operators import series as sr


def frame(lists):
    days = pd.date_range("1990-01-01", periods=max(map(len, lists.values())))
    return pd.concat([pd.DataFrame({"entity": e, "date": days[:len(x)].date, "v": x}) for e, x in lists.items()], ignore_index=True)


@pytest.fixture(scope="module")
def lists():
    rng = np.random.default_rng(9)
    t = np.arange(10007)  # a prime number of days
    return {"long": 5e4 + 3 * np.sin(2 * np.pi * t / 91) + np.sin(2 * np.pi * t / 7) + 0.1 * rng.normal(size=len(t)), "even": rng.normal(size=240).cumsum(),
            "flat": np.full(9, 2.0), "edge": np.concatenate([np.zeros(20), rng.normal(size=41)]), "two": np.array([1.0, 2.0]), "one": np.array([1.0])}


def test_dominant_periods(spark, lists):
    df = spark.createDataFrame(frame(lists)).repartition(3)
    got = sr.dominant_periods(df, "v", 3).toPandas()
    for e in ("even", "edge", "two"):
        x = lists[e]
        n = len(x)
        f = np.arange(1, n // 2 + 1)
        size = np.abs(np.exp(-2j * np.pi * np.outer(f, np.arange(n)) / n) @ x)
        mine = got[got.entity == e].sort_values("rank")
        order = np.argsort(-size, kind="stable")[:3]
        assert mine.freq.tolist() == f[order].tolist() and np.allclose(mine.amplitude, size[order]) and (mine.period == n // mine.freq).all()
    assert got[got.entity == "long"].sort_values("rank").freq.tolist()[:2] == [110, 1430] and "one" not in set(got.entity)
    last = sr.dominant_periods(df, "v", 1, max_t=28).toPandas().set_index("entity")
    assert last.loc["long", "freq"] == 4 and last.loc["long", "period"] == 7


def correlations(x, circular):
    out = {}
    for k in range(1, len(x)):
        a, b = (np.roll(x, -k), x) if circular else (x[k:], x[:-k])
        if a.std() > 1e-12 and b.std() > 1e-12:
            out[k] = np.corrcoef(a, b)[0, 1]
    return out


@pytest.mark.parametrize("circular", [False, True])
def test_autocorrelations(spark, lists, circular):
    for x in lists.values():
        x = x[:700]
        got = sr.lag_correlations(x, len(x) - 1, circular)
        want = correlations(x, circular)
        assert {k + 1 for k in np.flatnonzero(~np.isnan(got))} == set(want)
        assert np.allclose([got[k - 1] for k in want], list(want.values()), atol=1e-9)
    df = spark.createDataFrame(frame(lists)).repartition(3)
    got = sr.autocorr_top_lags(df, "v", circular=circular).toPandas()
    assert got[got.entity == "long"].sort_values("rank").lag.iloc[0] % 91 == 0 or circular
    assert np.allclose(got.groupby("entity").weight.sum(), 1) and len(got[got.entity == "long"]) == 9
    assert {"flat", "one"}.isdisjoint(got.entity)
