"""Queries: bar expressions, rolling features, sentiment decay and per-series helpers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barweave.functions.calendar import PARTS_BY_FREQUENCY, calendar_features
from barweave.functions.maths import inf_to_null
from barweave.operators import features as ft
from barweave.operators import sentiment as st
from barweave.operators import series as sr
from barweave.plans.fixtures import (
    ARTICLES, BARS, DAILY, DAY_BARS, EVENT_BARS, articles, bars, event_bars, table,
)
from barweave.plans.registry import query

FRAMES = [5, 10, 20, 30, 60]
W = "PARTITION BY entity ORDER BY date"
FRAME_SQL = "WINDOW w AS (" + W + "), " + ", ".join(
    f"w{d} AS ({W} ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)" for d in FRAMES)

INPUTS = f"""inputs AS (
  SELECT *, lv - lag(lv) OVER w AS dlv FROM (
    SELECT *, CASE WHEN lag(close) OVER w IS NOT NULL THEN ln(close / greatest(lag(close) OVER w, 1e-9)) END AS r1,
      greatest(CAST(volume AS DOUBLE), 1.0) AS v, ln(greatest(CAST(volume AS DOUBLE), 1.0)) AS lv
    FROM bars WINDOW w AS ({W})) b WINDOW w AS ({W}))"""


def full(value: str, counted: str, d: int) -> str:
    return f"CASE WHEN count({counted}) OVER w{d} = {d} THEN {value} END"


def sql_corr(a: str, b: str, over: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    sx, sy = f"stddev_pop({x}) {over}", f"stddev_pop({y}) {over}"
    return f"CASE WHEN {sx} > 1e-12 AND {sy} > 1e-12 THEN (covar_pop({x}, {y}) {over}) / (({sx}) * ({sy})) END"


def lagged_return(d: int) -> str:
    return f"CASE WHEN lag(close, {d}) OVER w IS NOT NULL THEN ln(close / greatest(lag(close, {d}) OVER w, 1e-9)) END"


def rank_sql(d: int) -> str:
    held = f"list(close) OVER w{d}"
    less = f"len(list_filter({held}, lambda x: x < close))"
    equal = f"len(list_filter({held}, lambda x: x = close))"
    return full(f"({less} + ({equal} + 1) / 2.0) / {d}.0", "close", d)


FAMILY_SQL = {
    "RET": lagged_return,
    "MA": lambda d: full(f"close / (avg(close) OVER w{d} + 1e-9) - 1", "close", d),
    "STD": lambda d: full(f"stddev_samp(r1) OVER w{d}", "r1", d),
    "MAX": lambda d: full(f"max(close) OVER w{d} / (close + 1e-9) - 1", "close", d),
    "MIN": lambda d: full(f"min(close) OVER w{d} / (close + 1e-9) - 1", "close", d),
    "RANK": rank_sql,
    "HL": lambda d: full(f"(max(high) OVER w{d} - min(low) OVER w{d}) / (close + 1e-9)", "close", d),
    "VMA": lambda d: full(f"v / (avg(v) OVER w{d} + 1e-9) - 1", "v", d),
    "VSTD": lambda d: full(f"stddev_samp(lv) OVER w{d}", "lv", d),
    "CORR": lambda d: f"CASE WHEN count(r1 + dlv) OVER w{d} = {d} THEN {sql_corr('r1', 'dlv', f'OVER w{d}')} END",
    "MOM": lambda d: f"(close - lag(close, {d}) OVER w) / (lag(close, {d}) OVER w + 1e-9)",
}
KLINE_SQL = {
    "KMID": "(close - open) / greatest(open, 1e-9)", "KLEN": "(high - low) / greatest(open, 1e-9)",
    "KMID2": "(close - open) / greatest(high - low, 1e-9)", "KUP": "(high - greatest(open, close)) / greatest(open, 1e-9)",
    "KLOW": "(least(open, close) - low) / greatest(open, 1e-9)",
    "KSFT": "(2.0 * close - high - low) / greatest(open, 1e-9)", "KSFT2": "(2.0 * close - high - low) / greatest(high - low, 1e-9)",
}


def family_sql(names: list[str]) -> str:
    cols = ", ".join(f"{FAMILY_SQL[n.split('_')[0]](int(n.split('_')[1]))} AS {n}" for n in names)
    return f"SELECT entity, date, {cols} FROM inputs {FRAME_SQL}"


def register_family(key: str, names: list[str]) -> None:
    spec = "entity:i date:d " + " ".join(f"{n}:f" for n in names)

    @query(key, spec, family_sql(names), [BARS, INPUTS])
    def run(spark, sf_dir):
        return ft.rolling(bars(spark, sf_dir), names)


# Query name -> feature family and window lengths.
for key, family, ds in [
    ("ret_d", "RET", FRAMES), ("ma_d", "MA", FRAMES), ("std_d", "STD", FRAMES), ("max_d", "MAX", FRAMES),
    ("min_d", "MIN", FRAMES), ("rank_d", "RANK", FRAMES), ("hl_d", "HL", FRAMES), ("vma_d", "VMA", FRAMES),
    ("vstd_d", "VSTD", FRAMES), ("corr_d", "CORR", [10, 20, 60]), ("mom_d", "MOM", [5, 10, 20]),
]:
    register_family(key, [f"{family}_{d}" for d in ds])


# ---- bar expressions -----------------------------------------------------------

@query("adjust_ohlc", "entity:i date:d open:f high:f low:f close:f",
       "SELECT entity, date, open * k AS open, high * k AS high, low * k AS low, close * k AS close FROM ("
       "SELECT *, coalesce(adj_close, close) / CASE WHEN close > 1e-9 THEN close ELSE 1.0 END AS k FROM bars) b", [BARS])
def adjust_ohlc(spark, sf_dir):
    return ft.adjust_ohlc(bars(spark, sf_dir))


@query("log1p_volume", "entity:i date:d log_volume:f",
       "SELECT entity, date, ln(1 + greatest(volume, 0)) AS log_volume FROM bars", [BARS])
def log1p_volume(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("log_volume", ft.log1p_volume())


@query("kline_shape", "entity:i date:d " + " ".join(f"{k}:f" for k in KLINE_SQL),
       "SELECT entity, date, " + ", ".join(f"{e} AS {k}" for k, e in KLINE_SQL.items()) + " FROM bars", [BARS])
def kline_shape(spark, sf_dir):
    return ft.kline(bars(spark, sf_dir))


PART_SQL_OF = {
    "minute_of_hour": "minute(ts) / 59.0 - 0.5", "hour_of_day": "hour(ts) / 23.0 - 0.5", "day_of_week": "(isodow(ts) - 1) / 6.0 - 0.5",
    "day_of_month": "(day(ts) - 1) / 30.0 - 0.5", "day_of_year": "(dayofyear(ts) - 1) / 365.0 - 0.5", "month_of_year": "(month(ts) - 1) / 11.0 - 0.5",
    "week_of_year": "(week(ts) - 1) / 52.0 - 0.5"}


@query("calendar_sets", "event_id:i " + " ".join(f"{f}_{p}:f" for f in "DHWTBMQ" for p in PARTS_BY_FREQUENCY[f]),
       "SELECT event_id, " + ", ".join(f"{PART_SQL_OF[p]} AS {f}_{p}" for f in "DHWTBMQ" for p in PARTS_BY_FREQUENCY[f]) + " FROM events")
def calendar_sets(spark, sf_dir):
    """The feature sets of all frequencies other than seconds, side by side."""
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = ev
    for f in "DHWTBMQ":
        out = calendar_features(out, "ts", f).withColumnsRenamed({p: f"{f}_{p}" for p in PARTS_BY_FREQUENCY[f]})
    return out


@query("calendar_features",
       "event_id:i second_of_minute:f minute_of_hour:f hour_of_day:f day_of_week:f day_of_month:f day_of_year:f "
       "month_of_year:f week_of_year:f",
       """SELECT event_id, floor(second(ts)) / 59.0 - 0.5 AS second_of_minute, minute(ts) / 59.0 - 0.5 AS minute_of_hour,
  hour(ts) / 23.0 - 0.5 AS hour_of_day, (isodow(ts) - 1) / 6.0 - 0.5 AS day_of_week, (day(ts) - 1) / 30.0 - 0.5 AS day_of_month,
  (dayofyear(ts) - 1) / 365.0 - 0.5 AS day_of_year, (month(ts) - 1) / 11.0 - 0.5 AS month_of_year,
  (week(ts) - 1) / 52.0 - 0.5 AS week_of_year FROM events""")
def calendar(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = calendar_features(ev, "ts", "S")
    from barweave.functions.calendar import calendar_part
    return out.withColumns({n: calendar_part(n, "ts") for n in ("month_of_year", "week_of_year")})


@query("inf_to_null", "entity:i date:d log_gap:f",
       """SELECT entity, date, CASE WHEN high - low > 0 THEN ln(high - low) END AS log_gap FROM bars""", [BARS])
def inf_query(spark, sf_dir):
    gap = F.col("high") - F.col("low")
    raw = bars(spark, sf_dir).withColumn("log_gap", F.when(gap > 0, F.ln(gap)).otherwise(F.lit(float("-inf"))))
    return inf_to_null(raw, ["log_gap"])


@query("drop_incomplete", "entity:i date:d STD_60:f",
       f"""SELECT entity, date, STD_60 FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM (
  SELECT entity, date, {FAMILY_SQL['STD'](60)} AS STD_60 FROM inputs {FRAME_SQL}) f WHERE STD_60 IS NOT NULL) g WHERE n >= 230""",
       [BARS, INPUTS])
def drop_incomplete(spark, sf_dir):
    return ft.complete_rows(ft.rolling(bars(spark, sf_dir), ["STD_60"]), ["STD_60"], 230)


# ---- full feature set ------------------------------------------------------------

ALPHA = [n for n in ft.feature_names() if not n.startswith("SENT")]
SENT_SQL = {
    "SENT_DELTA": "scaled_sentiment - 0.5",
    "SENT_MA_5": full("avg(scaled_sentiment) OVER w5 - 0.5", "scaled_sentiment", 5),
    "SENT_MA_20": full("avg(scaled_sentiment) OVER w20 - 0.5", "scaled_sentiment", 20),
    "SENT_STD_5": full("stddev_samp(scaled_sentiment) OVER w5", "scaled_sentiment", 5),
    "SENT_STD_20": full("stddev_samp(scaled_sentiment) OVER w20", "scaled_sentiment", 20),
}
ALL_SQL = {n: KLINE_SQL.get(n) or SENT_SQL.get(n) or FAMILY_SQL[n.split("_")[0]](int(n.split("_")[1])) for n in ft.feature_names()}


@query("alpha_features", "entity:i date:d " + " ".join(f"{n}:f" for n in ft.feature_names()),
       "SELECT entity, date, " + ", ".join(f"{ALL_SQL[n]} AS {n}" for n in ft.feature_names())
       + f" FROM (SELECT *, 0.5 + 0.4 * sin(volume) AS scaled_sentiment FROM inputs) i {FRAME_SQL}", [BARS, INPUTS])
def alpha(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("scaled_sentiment", 0.5 + 0.4 * F.sin("volume"))
    return ft.alpha_features(b)


ADJUSTED = [BARS.replace("bars AS (", "raw_bars AS (", 1), """bars AS (SELECT entity, date, open * k AS open, high * k AS high, low * k AS low, close * k AS close, volume FROM (
  SELECT *, coalesce(adj_close, close) / CASE WHEN close > 1e-9 THEN close ELSE 1.0 END AS k FROM raw_bars) r)"""]
PREPARED = ", ".join(f"{ALL_SQL[n]} AS {n}" for n in ft.feature_names())


@query("prepared_bars", "entity:i date:d close:f log_volume:f " + " ".join(f"{n}:f" for n in ft.feature_names()),
       f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS kept FROM (
  SELECT entity, date, close, ln(1 + greatest(volume, 0)) AS log_volume, {PREPARED} FROM (SELECT *, 0.5 AS scaled_sentiment FROM inputs) i {FRAME_SQL}) f
  WHERE {" AND ".join(f"{n} IS NOT NULL" for n in ft.feature_names())}) g WHERE kept >= 200""", [*ADJUSTED, INPUTS])
def prepared_bars(spark, sf_dir):
    return ft.prepared_bars(bars(spark, sf_dir), 200)


# ---- sentiment ----------------------------------------------------------------------

MERGED = f"""merged AS (
  SELECT b.entity, b.date, b.close, b.volume, coalesce(d.article_count, 0) AS article_count, d.scaled_sentiment, d.avg_composite
  FROM event_bars b LEFT JOIN daily d USING (entity, date)),
faded AS (
  SELECT *, CASE WHEN article_count > 0 THEN scaled_sentiment
      ELSE coalesce(0.5 + (last_s - 0.5) * exp(-ln(2) / 5.0 * (rn - last_rn)), 0.5) END AS sent,
    CASE WHEN article_count > 0 THEN avg_composite
      ELSE coalesce(0.0 + (last_c - 0.0) * exp(-ln(2) / 5.0 * (rn - last_rn)), 0.0) END AS comp
  FROM (SELECT *, last_value(CASE WHEN article_count > 0 THEN scaled_sentiment END IGNORE NULLS) OVER w AS last_s,
      last_value(CASE WHEN article_count > 0 THEN avg_composite END IGNORE NULLS) OVER w AS last_c,
      last_value(CASE WHEN article_count > 0 THEN rn END IGNORE NULLS) OVER w AS last_rn
    FROM (SELECT *, row_number() OVER ({W}) AS rn FROM merged) m WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) q)"""
SENTIMENT = [ARTICLES, DAILY, EVENT_BARS, MERGED]


def merged_bars(spark, sf_dir):
    return st.merged_bars(event_bars(spark, sf_dir), st.daily_sentiment(articles(spark, sf_dir)))


@query("sentiment_scores", "article_id:i composite_score:f scaled_sentiment:f",
       "SELECT article_id, composite_score, scaled_sentiment FROM articles", [ARTICLES])
def sentiment_scores(spark, sf_dir):
    return articles(spark, sf_dir)


@query("daily_sentiment",
       "entity:i date:d avg_composite:f scaled_sentiment:f avg_positive:f avg_negative:f avg_neutral:f article_count:i",
       "SELECT * FROM daily", [ARTICLES, DAILY])
def daily_sentiment(spark, sf_dir):
    return st.daily_sentiment(articles(spark, sf_dir))


@query("merge_sentiment", "entity:i date:d close:f article_count:i scaled_sentiment:f",
       "SELECT * FROM merged", SENTIMENT)
def merge_sentiment(spark, sf_dir):
    return st.merge_daily(event_bars(spark, sf_dir), st.daily_sentiment(articles(spark, sf_dir)))


@query("decay_impute", "entity:i date:d scaled_sentiment:f avg_composite:f",
       "SELECT entity, date, sent AS scaled_sentiment, comp AS avg_composite FROM faded", SENTIMENT)
def decay(spark, sf_dir):
    return merged_bars(spark, sf_dir)


for family in ("delta", "ma", "std"):
    names = [n for n in SENT_SQL if n.lower().startswith(f"sent_{family}")]

    def register_sent(key: str, names: list[str]) -> None:
        @query(key, "entity:i date:d " + " ".join(f"{n}:f" for n in names),
               "SELECT entity, date, " + ", ".join(f"{SENT_SQL[n]} AS {n}" for n in names)
               + f" FROM (SELECT entity, date, sent AS scaled_sentiment FROM faded) s {FRAME_SQL}", SENTIMENT)
        def run(spark, sf_dir):
            return ft.rolling(merged_bars(spark, sf_dir), names)

    register_sent(f"sent_{family}", names)


# ---- volatility ----------------------------------------------------------------------

VOL = f"""vols AS (
  SELECT *, CASE WHEN count(r) OVER w20 = 20 THEN stddev_samp(r) OVER w20 * sqrt(252.0) END AS realized_vol FROM (
    SELECT *, ln(greatest(close, 1e-6)) - ln(greatest(lag(close) OVER w, 1e-6)) AS r0,
      CASE WHEN lag(close) OVER w IS NOT NULL THEN ln(greatest(close, 1e-6)) - ln(greatest(lag(close) OVER w, 1e-6)) END AS r
    FROM bars WINDOW w AS ({W})) b WINDOW w20 AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query("realized_vol", "entity:i date:d realized_vol:f", "SELECT entity, date, realized_vol FROM vols", [BARS, VOL])
def realized_vol(spark, sf_dir):
    return ft.realized_vol(bars(spark, sf_dir))


@query("log_vol_target", "entity:i date:d log_vol_target:f",
       f"""SELECT entity, date, CASE WHEN count(d) OVER w20 = 20 THEN ln(stddev_pop(d) OVER w20 + 1e-3) END AS log_vol_target FROM (
  SELECT entity, date, z - lag(z) OVER ({W}) AS d FROM (
    SELECT entity, date, (close - avg(close) OVER p) / stddev_pop(close) OVER p AS z FROM bars WINDOW p AS (PARTITION BY entity)) a) b
  WINDOW w20 AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", [BARS])
def log_vol_target(spark, sf_dir):
    from pyspark.sql import Window
    own = Window.partitionBy("entity")
    z = (F.col("close") - F.avg("close").over(own)) / F.stddev_pop("close").over(own)
    return ft.log_vol_target(bars(spark, sf_dir).withColumn("close_z", z))


@query("vol_zscore", "entity:i date:d vol_z:f",
       f"""SELECT entity, date, CASE WHEN row_number() OVER ({W}) > 40 THEN
  (realized_vol - avg(realized_vol) OVER p) / (stddev_samp(realized_vol) OVER p + 1e-12) END AS vol_z
  FROM vols WINDOW p AS ({W} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)""", [BARS, VOL])
def vol_zscore(spark, sf_dir):
    return ft.vol_zscore(ft.realized_vol(bars(spark, sf_dir)))


def unit_bars(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("unit", F.col("close") / 123457.0)


# ---- series helpers ---------------------------------------------------------------------

@query("series_decompose", "entity:i date:d trend:f residual:f",
       f"""SELECT entity, date, trend, close - trend AS residual FROM (SELECT *, (s + greatest(0, 13 - i) * a + greatest(0, i + 12 - n) * z) / 25.0 AS trend
  FROM (SELECT entity, date, close, row_number() OVER w AS i, count(*) OVER (PARTITION BY entity) AS n,
    first_value(close) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a,
    last_value(close) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z,
    sum(close) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS s FROM (SELECT entity, date, close / 123457.0 AS close FROM bars) u WINDOW w AS ({W})) q) r""", [BARS])
def series_decompose(spark, sf_dir):
    return sr.series_decompose(unit_bars(spark, sf_dir), "unit")


DECAYED = f"""numbered AS (SELECT entity, date, close / 123457.0 AS close, row_number() OVER ({W}) AS t FROM bars)"""


@query("ema_bias_corrected", "entity:i date:d ema:f",
       """SELECT a.entity, a.date, sum(0.05 * pow(0.95, a.t - b.t) * b.close) / (1 - pow(0.95, a.t)) AS ema
  FROM numbered a JOIN numbered b ON a.entity = b.entity AND b.t <= a.t GROUP BY a.entity, a.date, a.t""", [BARS, DECAYED])
def ema(spark, sf_dir):
    return sr.ema(unit_bars(spark, sf_dir), "unit", 0.95)


@query("exp_smoothing", "entity:i date:d smoothed:f",
       """SELECT a.entity, a.date, sum((1 - 0.7310585786300049) * pow(0.7310585786300049, a.t - b.t) * b.close) + pow(0.7310585786300049, a.t) * 0.4 AS smoothed
  FROM numbered a JOIN numbered b ON a.entity = b.entity AND b.t <= a.t GROUP BY a.entity, a.date, a.t""", [BARS, DECAYED])
def exp_smoothing(spark, sf_dir):
    return sr.exp_smoothing(unit_bars(spark, sf_dir), "unit", 0.7310585786300049, 0.4)


def normal_sql(centre: str) -> str:
    return f"""SELECT entity, date, (close - {centre}) / s AS wn_close, (volume - {centre.replace('close', 'volume')}) / sv AS wn_volume, close AS back FROM (
  SELECT entity, date, close, volume, row_number() OVER ({W}) AS rn, avg(close) OVER w52 AS m_close, avg(volume) OVER w52 AS m_volume,
    sqrt(var_pop(close) OVER w52 + 1e-5) AS s, sqrt(var_pop(volume) OVER w52 + 1e-5) AS sv
  FROM bars WINDOW w52 AS ({W} ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)) q WHERE rn >= 52"""


def register_normalize(name: str, centre: str, subtract_last: bool) -> None:
    @query(name, "entity:i date:d wn_close:f wn_volume:f back:f", normal_sql(centre), [BARS])
    def run(spark, sf_dir):
        out = sr.window_normalize(bars(spark, sf_dir), ["close", "volume"], 52, subtract_last)
        return sr.window_denormalize(out, ["close"]).withColumn("back", F.col("close"))


register_normalize("window_normalize", "m_close", False)
register_normalize("window_normalize_last", "close", True)


@query("point_adjust", "entity:i event_id:i truth:b hit:b adjusted:b",
       """SELECT entity, event_id, truth, hit, CASE WHEN truth THEN bool_or(hit AND truth) OVER (PARTITION BY entity, run) ELSE hit END AS adjusted FROM (
  SELECT *, coalesce(max(CASE WHEN NOT truth THEN event_id END) OVER (PARTITION BY entity ORDER BY event_id), -1) AS run FROM (
    SELECT user_id AS entity, event_id, event_type = 'error' AS truth, value > 50 AS hit FROM events) e) r""")
def point_adjust(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), "event_id", (F.col("event_type") == "error").alias("truth"), (F.col("value") > 50).alias("hit"))
    return sr.point_adjust(ev, "truth", "hit")


@query("time_trend_corr", "entity:i n:i sd:f time_corr:f",
       f"""SELECT entity, count(*) AS n, stddev_samp(close) AS sd, {sql_corr('i', 'close', '')} AS time_corr FROM (
  SELECT entity, close, CAST(row_number() OVER ({W}) AS DOUBLE) AS i FROM bars) b GROUP BY entity""", [BARS])
def time_trend_corr(spark, sf_dir):
    from barweave.operators.quality import time_trend_corr as op
    return op(bars(spark, sf_dir), "close")


POSITIONED = f"""positioned AS (
  SELECT entity, close AS x, row_number() OVER ({W}) - 1 AS t, count(*) OVER (PARTITION BY entity) AS n FROM bars)"""


@query("dominant_periods", "entity:i rank:i freq:i period:i amplitude:g",
       f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY amplitude DESC, freq) AS rank FROM (
  SELECT entity, freq, n // freq AS period, sqrt(pow(sum(x * cos(2 * pi() * ((freq * t) % n) / n)), 2) + pow(sum(x * sin(2 * pi() * ((freq * t) % n) / n)), 2)) AS amplitude
  FROM (SELECT *, unnest(generate_series(1, n // 2)) AS freq FROM positioned) p GROUP BY entity, freq, n) a) r WHERE rank <= 3""",
       [BARS, POSITIONED])
def dominant_periods(spark, sf_dir):
    return sr.dominant_periods(bars(spark, sf_dir), "close", 3)


@query("autocorr_top_lags", "entity:i rank:i lag:i autocorr:f weight:f",
       f"""SELECT entity, rank, lag, r AS autocorr, exp(r) / sum(exp(r)) OVER (PARTITION BY entity) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY r DESC, lag) AS rank FROM (
    SELECT a.entity, a.n, a.t - b.t AS lag, {sql_corr('a.x', 'b.x', '')} AS r FROM positioned a JOIN positioned b
    ON a.entity = b.entity AND a.t > b.t GROUP BY a.entity, a.n, a.t - b.t) c WHERE r IS NOT NULL) d
  WHERE rank <= floor(ln(n))""", [BARS, POSITIONED])
def autocorr_top_lags(spark, sf_dir):
    return sr.autocorr_top_lags(bars(spark, sf_dir), "close")


@query("autocorr_circular", "entity:i rank:i lag:i autocorr:f weight:f",
       f"""SELECT entity, rank, lag, r AS autocorr, exp(r) / sum(exp(r)) OVER (PARTITION BY entity) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(r, 9) DESC, lag) AS rank FROM (
    SELECT a.entity, a.n, (a.t - b.t + a.n) % a.n AS lag, {sql_corr('a.x', 'b.x', '')} AS r FROM positioned a JOIN positioned b
    ON a.entity = b.entity AND a.t <> b.t GROUP BY a.entity, a.n, (a.t - b.t + a.n) % a.n) c WHERE r IS NOT NULL) d
  WHERE rank <= floor(ln(n))""", [BARS, POSITIONED])
def autocorr_circular(spark, sf_dir):
    return sr.autocorr_top_lags(bars(spark, sf_dir), "close", circular=True)
