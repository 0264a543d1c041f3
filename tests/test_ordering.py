"""Bucketed ranks, quantiles and positions against brute force, with one group holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import inference as inf
from barweave.operators.ordering import exact_quantiles, last_before, range_ranks, running_index, value_ranks


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"g": "hot", "v": np.where(rng.random(900) < 0.4, 0.0, rng.normal(size=900).round(2))})
    cold = pd.DataFrame({"g": rng.choice(list("abc"), 120), "v": rng.normal(size=120).round(1)})
    out = pd.concat([hot, cold], ignore_index=True)
    out["id"] = np.arange(len(out))
    return out


def test_value_ranks(spark, skewed):
    got = value_ranks(spark.createDataFrame(skewed), ["g"], "v", splits=8).toPandas()
    want = skewed.groupby("g")["v"].rank(method="min").astype(int) - 1
    want = skewed.assign(n_less=want).groupby(["g", "v"]).agg(n_less=("n_less", "first"), n_eq=("id", "size")).reset_index()
    both = got.merge(want, left_on=["g", "value"], right_on=["g", "v"], suffixes=("", "_w"))
    assert len(both) == len(got) == len(want)
    assert (both.n_less == both.n_less_w).all() and (both.n_eq == both.n_eq_w).all()
    assert got[got.g == "hot"].bucket.nunique() > 4


@pytest.mark.parametrize("keys", [["g"], []])
def test_exact_quantiles(spark, skewed, keys):
    df = spark.createDataFrame(skewed)
    got = exact_quantiles(df, keys, "v", {"q1": 0.1, "q5": 0.5, "q9": 0.9}).toPandas()
    groups = skewed.groupby("g") if keys else [("", skewed)]
    for name, part in groups:
        row = got[got.g == name].iloc[0] if keys else got.iloc[0]
        assert np.allclose([row.q1, row.q5, row.q9], np.percentile(part.v, [10, 50, 90]))
    low = exact_quantiles(df, [], "v", {"m": 0.5}, interpolate=False).first()["m"]
    assert low == np.sort(skewed.v)[(len(skewed) - 1) // 2]


def test_running_index_and_last_before(spark, skewed):
    df = spark.createDataFrame(skewed)
    slot = F.floor(F.col("id") / 50)
    got = running_index(df, ["g"], ["id"], slot).toPandas().set_index("id").idx
    assert (got.sort_index() == skewed.groupby("g").cumcount()).all()
    got = last_before(df, ["g"], "id", slot, F.col("v") > 0.5, "at").toPandas().set_index("id")["at"].sort_index()
    want = skewed.id.where(skewed.v > 0.5).groupby(skewed.g).ffill()
    assert got.fillna(-1).tolist() == want.fillna(-1).tolist()


def tau_b(x, y):
    i, j = np.triu_indices(len(x), 1)
    sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    return (sx * sy).sum() / np.sqrt((sx != 0).sum() * float((sy != 0).sum()))


def test_rank_correlations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300).round(1)
    y = (0.5 * x + rng.normal(size=300)).round(1)
    pdf = pd.DataFrame({"date": np.where(np.arange(300) < 220, "d1", "d2"), "pred": x, "actual": y})
    pdf = pd.concat([pdf, pd.DataFrame({"date": ["d3"] * 4, "pred": [1.0, 2, 3, 4], "actual": [1.0, 2, 3, 4]})])
    df = spark.createDataFrame(pdf)
    rho = inf.rank_ic(df, [], "spearman").toPandas().set_index("date").ic
    tau = inf.rank_ic(df, [], "kendall").toPandas().set_index("date").ic
    assert set(rho.index) == {"d1", "d2"}  # d3 has fewer than five pairs
    for d in ("d1", "d2"):
        part = pdf[pdf.date == d]
        assert np.isclose(rho[d], part.pred.rank().corr(part.actual.rank()))
        assert np.isclose(tau[d], tau_b(part.pred.to_numpy(), part.actual.to_numpy()))


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_ranges_cut_groups_and_ties(spark, parts):
    """A group and a value that span many ranges, NaN, null keys and strings: ranks as of the whole group."""
    rng = np.random.default_rng(parts)
    rows = [("hot", float(v), int(i), 1 + i % 3) for i, v in enumerate(np.where(rng.random(800) < 0.5, 0.0, rng.integers(-9, 9, 800)))]
    rows += [(g, float(v), 900 + i, 1) for i, (g, v) in enumerate(zip(rng.choice(["a", "b", "z"], 60), rng.integers(0, 4, 60)))]
    rows += [(None, 1.0, 2000, 5), (None, float("nan"), 2001, 2), (None, float("nan"), 2002, 1), ("one", -0.0, 2003, 1), ("one", 0.0, 2004, 1), ("x", None, 2005, 1)]
    df = spark.createDataFrame(rows, "g string, v double, id int, w int").repartition(5)
    got = {r["id"]: r for r in range_ranks(df, ["g"], "v", "w", ties=["id"], parts=parts).collect()}
    known = [r for r in rows if r[1] is not None]
    assert len(got) == len(known)
    key = lambda v: (v != v, 0.0 if v != v else v)
    for g, v, i, _ in known:
        group = [(key(x), w) for h, x, _, w in known if h == g]
        want = (sum(w for x, w in group if x < key(v)), sum(w for x, w in group if x == key(v)), sum(w for _, w in group))
        assert (got[i]["n_less"], got[i]["n_eq"], got[i]["n_total"]) == want
    if parts > 7:
        assert len({got[i]["bucket"] for _, v, i, _ in rows[:800] if v == 0}) > 5
    assert range_ranks(df.limit(0), ["g"], "v").collect() == []


def test_one_range_exchange_ranks_both_sides(spark):
    """Rank IC: few exchanges, and with broadcasts off no join on the group's key."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        panel = spark.range(2000).selectExpr("id % 7 AS date", "rand(1) AS pred", "rand(2) AS actual")
        plan = inf.rank_ic(panel, [], "spearman")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 6 and plan.count("Window") == 0 and "SortMergeJoin" not in plan
        assert "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin [_part") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
