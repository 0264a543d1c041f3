"""Readers, rolling frames, lags, time zones, smoothing and the shared folder on awkward input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave import session
from barweave.functions.calendar import utc_day, utc_day_text
from barweave.functions.text import select_text, text_source
from barweave.operators import bootstrap as bs
from barweave.operators import features as ft
from barweave.operators import inference as inf
from barweave.operators import series as sr
from barweave.operators.ordering import exact_quantiles
from barweave.sources.readers import read_news, read_prices, stage_news


def test_columns_are_found_by_header(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "abc.csv").write_text("Date,VOLUME,open, High ,low,close,Adj Close,note\n2020-01-02,1000,1,3,0.5,2,1.9,x\nbad,1,1,1,1,1,1,y\n")
    row = read_prices(spark, str(tmp_path / "p")).first().asDict()
    assert (row["entity"], row["open"], row["high"], row["low"], row["close"], row["adj_close"], row["volume"]) == ("ABC", 1.0, 3.0, 0.5, 2.0, 1.9, 1000.0)
    news = tmp_path / "news.csv"
    news.write_text('id,Article,Stock_symbol,Date\n7,"two\nlines, ""quoted""",aa,2020-01-02 03:04:05 UTC\n8,x,,2020-01-02\n')
    row = read_news(spark, str(news)).collect()
    assert [(r["entity"], r["body"], str(r["ts"]), r["publisher"]) for r in row] == [("AA", 'two\nlines, "quoted"', "2020-01-02 03:04:05", None)]
    assert stage_news(spark, str(news), str(tmp_path / "staged"), 3).count() == 1
    (tmp_path / "bad.csv").write_text("Date,Article\n2020-01-02,x\n")
    with pytest.raises(ValueError, match="Stock_symbol"):
        read_news(spark, str(tmp_path / "bad.csv"))


@pytest.mark.parametrize("d", [3, 5, 7, 13])
def test_frames_of_any_length_forget_bad_bars(spark, d):
    rng = np.random.default_rng(d)
    n = 80
    pdf = pd.DataFrame({"entity": 1, "date": pd.date_range("2020-01-01", periods=n).date, "close": 100 + rng.normal(size=n).cumsum(), "volume": rng.uniform(10, 99, n)})
    pdf["high"], pdf["low"], pdf["open"] = pdf.close + 1, pdf.close - 1, pdf.close
    pdf.loc[20, ["close", "volume"]] = np.nan
    pdf.loc[45, "volume"] = np.inf
    pdf.loc[60, ["close", "high", "low"]] = 1e16
    names = [f"{f}_{d}" for f in ("MA", "STD", "MAX", "MIN", "HL", "VMA", "VSTD", "CORR", "RANK")]
    got = ft.rolling(spark.createDataFrame(pdf), names).orderBy("date").toPandas()
    c, v = pdf.close, pdf.volume.replace(np.inf, np.nan)
    r, dv = np.log(c / c.shift()), np.log(v).diff()
    r, dv = r.where(dv.notna()), dv.where(r.notna())
    want = pd.DataFrame({
        f"MA_{d}": c / (c.rolling(d).mean() + 1e-9) - 1, f"STD_{d}": np.log(c / c.shift()).rolling(d).std(), f"MAX_{d}": c.rolling(d).max() / (c + 1e-9) - 1,
        f"MIN_{d}": c.rolling(d).min() / (c + 1e-9) - 1, f"HL_{d}": (pdf.high.rolling(d).max() - pdf.low.rolling(d).min()) / (c + 1e-9),
        f"VMA_{d}": v / (v.rolling(d).mean() + 1e-9) - 1, f"VSTD_{d}": np.log(v).rolling(d).std(), f"RANK_{d}": c.rolling(d).rank(pct=True)})
    want[f"HL_{d}"] = want[f"HL_{d}"].where(c.rolling(d).count() == d)
    for k in (x for x in want if x != f"MA_{d}"):
        clean = [i for i in range(n) if not 60 <= i < 60 + d + 1]  # pandas carries the giant bar on; the frames here do not
        np.testing.assert_allclose(got[k].astype(float)[clean], want[k][clean], rtol=1e-6, atol=1e-9, err_msg=k)
    for i in (59, 60 + d, n - 1):
        assert np.isclose(got[f"MA_{d}"][i], c[i] / (c[i - d + 1:i + 1].mean() + 1e-9) - 1)
    i = 19
    assert np.isclose(got[f"CORR_{d}"][i], np.corrcoef(r[i - d + 1:i + 1], dv[i - d + 1:i + 1])[0, 1])


def test_pegged_price_has_a_correlation(spark):
    t = np.arange(40)
    pdf = pd.DataFrame({"entity": 1, "date": pd.date_range("2020-01-01", periods=40).date, "close": 1 + 1e-7 * np.sin(t), "volume": 50 + 20 * np.cos(t * 1.3)})
    got = ft.rolling(spark.createDataFrame(pdf), ["CORR_10"]).toPandas()
    assert got.CORR_10.notna().sum() == 30


def test_utc_day_in_another_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = spark.sql("SELECT timestamp_seconds(1577926800) AS ts").select(utc_day("ts").cast("string").alias("d"), utc_day_text("ts").alias("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (row["d"], row["t"]) == ("2020-01-02", "2020-01-02 00:00:00+00:00")


def test_white_space_is_no_article(spark):
    df = spark.createDataFrame([("t", "\n\t " * 40), (" \n", "x" * 51), ("\r\n", " "), ("t", " " + "y" * 60 + "\n")], "title string, body string")
    got = [(r[0], r[1]) for r in df.select(text_source("title", "body"), select_text("title", "body")).collect()]
    assert got == [("title", "t"), ("article", "x" * 51), ("empty", ""), ("article", " " + "y" * 60 + "\n")]


@pytest.mark.parametrize("alpha", [0.0, 1e-12, 0.3, 0.999])
def test_smoothing_for_any_decay(spark, alpha):
    x = np.random.default_rng(1).normal(size=100)
    df = spark.createDataFrame(pd.DataFrame({"entity": 1, "date": pd.date_range("2020-01-01", periods=100).date, "x": x}))
    got = sr.exp_smoothing(df, "x", alpha, 0.5).orderBy("date").toPandas().smoothed
    s, want = 0.5, []
    for v in x:
        s = alpha * s + (1 - alpha) * v
        want.append(s)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)


def test_lag_pairs_are_all_pairs(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(7)] + [("b", 0, 1.0)], "k string, i long, x double")
    plain = {(r["lag"], r["x"], r["x_lag"]) for r in inf.lag_pairs(df, ["k"], "i", "x", 100).collect()}
    assert plain == {(k, float(t * t), float((t - k) ** 2)) for k in range(1, 7) for t in range(k, 7)}
    wrapped = sorted((r["lag"], r["x"], r["x_lag"]) for r in inf.lag_pairs(df, ["k"], "i", "x", 6, circular=True).collect())
    assert wrapped == sorted((k, float(((t + k) % 7) ** 2), float(t * t)) for k in range(1, 7) for t in range(7))


def test_replicates_follow_the_draws(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"cell": "c", "row_idx": np.arange(30), "net": rng.normal(size=30), "horizon": 4}))
    rows = bs.with_block(bs.indexed(df, ["cell"], ["net"]), 3.0)
    picks = bs.resample(rows, ["cell"], 20, 7).toPandas()
    x = rows.orderBy("i").toPandas().net.to_numpy()
    got = bs.replicate_sharpes(rows, ["cell"], ["net"], 20, 7).toPandas().set_index("rep").s_net
    for rep, part in picks.groupby("rep"):
        drawn = x[part.sort_values("i").pick]
        assert np.isclose(got[rep], drawn.mean() / drawn.std(ddof=1) * np.sqrt(252 / 4))


def test_no_cell_disappears(spark):
    few = [(f, i, float(i % 3), 1) for f, n in (("F1", 3), ("F2", 30)) for i in range(n)]
    df = spark.createDataFrame(few, "fold string, row_idx long, net double, horizon int")
    out = {r["fold"]: (r["n"], r["status"]) for r in bs.paired_by_cell(df, df, ["fold"], 6, 50).collect()}
    assert out == {"F1": (3, "refused"), "F2": (30, "few")}


def test_quantiles_without_group_need_no_cross_join(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 1.0)
    plan = exact_quantiles(df, [], "v", {"m": 0.5})._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 499.5


def test_cluster_without_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        applicationId = "x"

        @staticmethod
        def getCheckpointDir():
            return None

    class Fake:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake)


def test_scratch_is_released(spark):
    path = session.scratch_path(spark, "probe")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    made, session._made[spark.sparkContext.applicationId] = session._made[spark.sparkContext.applicationId], [path]
    assert session.release_scratch(spark) == 1
    session._made[spark.sparkContext.applicationId] = made
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
