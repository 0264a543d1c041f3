"""Sentiment, splits, sources, streams and plan shapes."""

from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import features as ft
from barweave.operators import sentiment as st
from barweave.operators import splits as sp
from barweave.operators import universe as un
from barweave.plans import fixtures as fx
from barweave.session import scratch_path
from barweave.sources import load_summaries, read_news, read_prices, write_by_entity


def bars_frame(spark, n=80, entities=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(entities):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i, d in enumerate(pd.bdate_range("2020-01-01", periods=n)):
            c = float(close[i])
            rows.append((e, d.date(), c * 0.99, c * 1.02, c * 0.97, c, float(rng.integers(100, 900))))
    return spark.createDataFrame(rows, "entity int, date date, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("half_life", [5.0, 0.0])
def test_decay(spark, half_life):
    counts, values = [0, 1, 0, 0, 2, 0], [None, 0.9, None, None, 0.2, None]
    rows = [("e", date(2020, 1, i + 1), v, c) for i, (v, c) in enumerate(zip(values, counts))]
    df = spark.createDataFrame(rows, "entity string, date date, s double, article_count int")
    got = [r.s for r in st.decay_impute(df, "s", half_life=half_life).orderBy("date").collect()]
    k = 2 ** (-1 / 5)
    want = [0.5, 0.9, 0.5 + 0.4 * k, 0.5 + 0.4 * k * k, 0.2, 0.5 - 0.3 * k] if half_life else [0.5, 0.9, 0.5, 0.5, 0.2, 0.5]
    assert np.allclose(got, want)


def test_text_choice_and_plugged_scorer(spark):
    rows = [(1, "t", "x" * 60), (2, " title ", "short"), (3, " ", None), (4, None, " " * 80)]
    df = st.with_text(spark.createDataFrame(rows, "article_id int, title string, body string"))
    assert {r.article_id: (r.text_source, r.text_used) for r in df.collect()} == {1: ("article", "x" * 60), 2: ("title", " title ")}

    def scorer(texts):
        return pd.DataFrame({"n_tokens": [len(t) for t in texts], "positive_prob": 0.5, "negative_prob": 0.3, "neutral_prob": 0.2})

    got = st.score_articles(df, scorer, batch=1).orderBy("article_id").collect()
    assert [r.n_tokens for r in got] == [60, 7] and [r.text_source for r in got] == ["article", "title"]
    loaded = st.score_articles(df, load=lambda: scorer, batch=1).orderBy("article_id").collect()
    assert loaded == got
    assert np.isclose(got[0].composite_score, 0.2) and np.isclose(got[0].scaled_sentiment, 0.6)


def test_merge_keeps_bars(spark):
    bars = bars_frame(spark, 5, 1)
    day = bars.first().date
    daily = spark.createDataFrame([(0, day, 0.7, 3), (0, day, 0.6, 9)], "entity int, date date, scaled_sentiment double, article_count int")
    out = st.merge_daily(bars, daily)
    assert out.count() == 5 and out.where("article_count = 0").count() == 4


def test_rolling_features_against_pandas(spark):
    bars = bars_frame(spark)
    got = ft.alpha_features(bars).toPandas().sort_values(["entity", "date"])
    assert [c for c in got.columns if c in ft.feature_names()] == ft.feature_names() and len(ft.feature_names()) == 63
    for _, g in got.groupby("entity"):
        c, v = g.close, g.volume
        r, dv = np.log(c / c.shift()), np.log(v).diff()
        for d in (5, 20, 60):
            assert np.allclose(g[f"MA_{d}"], c / c.rolling(d).mean() - 1, atol=1e-9, equal_nan=True)
            assert np.allclose(g[f"STD_{d}"], r.rolling(d).std(), atol=1e-9, equal_nan=True)
            assert np.allclose(g[f"RANK_{d}"], c.rolling(d).rank(pct=True), equal_nan=True)
            assert np.allclose(g[f"HL_{d}"], (g.high.rolling(d).max() - g.low.rolling(d).min()) / c, atol=1e-8, equal_nan=True)
            assert np.allclose(g[f"VSTD_{d}"], np.log(v).rolling(d).std(), atol=1e-9, equal_nan=True)
        assert np.allclose(g["CORR_20"], r.rolling(20).corr(dv), atol=1e-9, equal_nan=True)


def test_constant_series_is_quiet(spark):
    flat = bars_frame(spark, 70, 1).withColumns({"close": F.lit(10.0), "volume": F.lit(5.0)})
    last = ft.rolling(flat, ["STD_20", "VSTD_20", "CORR_20", "RANK_20"]).orderBy(F.desc("date")).first()
    assert last.STD_20 == 0 and last.VSTD_20 < 1e-9 and last.CORR_20 is None and np.isclose(last.RANK_20, 10.5 / 20)


def test_purged_split_never_leaks(spark, sf_dir):
    folds = fx.FOLDS
    out = sp.purged_split(sp.sample_index(fx.bars(spark, sf_dir), 52, [1, 4]), folds).toPandas()
    for f in folds:
        for h in (1, 4):
            e = pd.Timedelta(days=int(np.ceil(h * 1.4)))
            s = {k: g for k, g in out[(out.fold == f.name) & (out.horizon == h)].groupby("split")}
            assert pd.to_datetime(s["train"].target_date).max() <= pd.Timestamp(f.train_end) - e
            assert pd.to_datetime(s["val"].date).min() >= pd.Timestamp(f.val_start) + e
            assert pd.to_datetime(s["val"].target_date).max() <= pd.Timestamp(f.val_end) - e
            assert pd.to_datetime(s["test"].date).min() >= pd.Timestamp(f.test_start) + e
    assert not out.duplicated(["entity", "horizon", "anchor_idx", "fold"]).any()


def test_sources(spark, tmp_path):
    news = tmp_path / "news.csv"
    news.write_text('Date,Stock_symbol,Article_title,Article,Url,Publisher\n'
                    '2020-01-02 10:00:00 UTC, aapl,"A ""quoted"" title","line one\nline two, still",u,p\nnonsense,MSFT,t,b,u,p\n')
    row = read_news(spark, str(news)).collect()
    assert len(row) == 1 and row[0].entity == "AAPL" and row[0].body == "line one\nline two, still" and row[0].ts == datetime(2020, 1, 2, 10)
    prices = tmp_path / "prices"
    prices.mkdir()
    (prices / "aapl.csv").write_text("date,open,high,low,close,adj close,volume\n2020-01-02,1,2,0.5,1.5,1.4,100\n")
    got = read_prices(spark, str(prices)).first()
    assert got.entity == "AAPL" and got.adj_close == 1.4 and got.date == date(2020, 1, 2)
    universe = spark.createDataFrame([("aapl",)], "entity string")
    articles = read_news(spark, str(news))
    assert un.prefilter(articles, universe).first().body == "line one\nline two, still"
    assert un.prefilter(articles, universe, max_chars=8).first().body == "line one"
    doc = tmp_path / "s.json"
    doc.write_text('{"model": "m", "horizon": 5, "fold": "F4", "arm": "mse", "ic_mean": NaN,\n "cost_sensitivity": {"20.0": {"net_sharpe": 1.5}},\n "sweep_topn": [{"top_n": 3, "val_sharpe_gross": 0.4}]}')
    s = load_summaries(spark, str(tmp_path / "s.json"), "F4").first()
    assert s.cost_sensitivity["20.0"].net_sharpe == 1.5 and s.sweep_topn[0].top_n == 3
    path = scratch_path(spark, "layout")
    write_by_entity(bars_frame(spark), path)
    assert spark.read.parquet(path).where("entity = 1").count() == 80


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark, sf_dir):
    bars = bars_frame(spark)
    plan = plan_of(ft.alpha_features(bars))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    signals = plan_of(fx.signals(spark, sf_dir))
    assert "CartesianProduct" not in signals and "NestedLoop" not in signals
    assert "Join" not in signals and signals.count("Scan parquet") == 1 and signals.count("Exchange hashpartitioning(entity") == 1


def test_a_panel_read_by_several_branches_is_made_once(spark, sf_dir):
    from barweave.plans.catalog import QUERIES
    for name in ("vol_kill_switch", "val_rank_ic", "newey_west_se", "ic_summary"):
        plan = plan_of(QUERIES[name].run(spark, sf_dir))
        assert plan.count("lineitem.parquet") == (1 if name == "vol_kill_switch" else 0), name  # the volatilities of the bars


def test_scaler_beside_the_rows_equals_the_joined_one(spark, sf_dir):
    b = fx.bars(spark, sf_dir).withColumn("close", F.when(F.col("entity") != 3, F.col("close")))
    by_join = sp.apply_scaler(sp.purged_split(sp.sample_index(b, 30, [1]), fx.FOLDS), sp.fit_scaler(b, fx.FOLDS, ["close"]), ["close"], ["entity", "fold"])
    beside = sp.apply_scaler(sp.purged_split(sp.sample_index(sp.fit_scaler(b, fx.FOLDS, ["close"], beside=True), 30, [1]), fx.FOLDS), fx.FOLDS, ["close"])
    cols = ["entity", "fold", "split", "anchor_idx", F.round("z_close", 9).alias("z"), F.round("sd_close", 6).alias("sd")]
    want, got = by_join.select(*cols), beside.select(*cols)
    assert got.count() == want.count() > 0 and want.exceptAll(got).isEmpty() and set(beside.columns) == set(by_join.columns)
    scan = plan_of(fx.table(spark, sf_dir, "lineitem").where("l_quantity > 10").select("l_suppkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in scan and "l_tax" not in scan
