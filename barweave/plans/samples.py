"""Queries: scalers, samples, purged splits and sample windows."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import functions as F

from barweave.operators import splits as sp
from barweave.plans.fixtures import (
    BARS, FOLD_ROWS, FOLDS, HORIZONS, LENGTH, SAMPLES, SCALER, bars, samples_sql,
)
from barweave.plans.registry import query
from barweave.plans.rolling import W


@query("fit_zscore", "entity:i fold:s date:d z_close:f",
       "SELECT entity, fold, date, (close - mu_close) / sd_close AS z_close FROM bars JOIN scaler USING (entity)", [BARS, FOLD_ROWS, SCALER])
def fit_zscore(spark, sf_dir):
    b = bars(spark, sf_dir)
    return sp.apply_scaler(b, sp.fit_scaler(b, FOLDS, ["close"]), ["close"])


@query("fit_minmax", "part:s entity:i date:d mm_close:f",
       """SELECT 'full' AS part, entity, date, (close - min(close) OVER e) / CASE WHEN max(close) OVER e = min(close) OVER e THEN 1 ELSE max(close) OVER e - min(close) OVER e END AS mm_close
  FROM bars WINDOW e AS (PARTITION BY entity)
  UNION ALL SELECT 'test', entity, date, (close - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END FROM bars JOIN (
    SELECT entity, min(close) AS lo, max(close) AS hi FROM bars WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1) v USING (entity)
  WHERE date >= DATE '2001-01-01'""", [BARS])
def fit_minmax(spark, sf_dir):
    b = bars(spark, sf_dir)
    whole = sp.apply_minmax(b, sp.fit_minmax(b, ["close"]), ["close"]).withColumn("part", F.lit("full"))
    val = sp.fit_minmax(b, ["close"], (Date(2000, 1, 1), Date(2000, 12, 31)))
    test = sp.apply_minmax(b.where(F.col("date") >= Date(2001, 1, 1)), val, ["close"]).withColumn("part", F.lit("test"))
    return whole.unionByName(test)


@query("standard_scale", "entity:i date:d scaled:f back:f",
       "SELECT entity, date, (close - avg(close) OVER e) / stddev_pop(close) OVER e AS scaled, close AS back FROM bars WINDOW e AS (PARTITION BY entity)",
       [BARS])
def standard_scale(spark, sf_dir):
    b = bars(spark, sf_dir)
    stats = b.groupBy("entity").agg(F.avg("close").alias("m"), F.stddev_pop("close").alias("s"))
    out = b.join(stats, "entity").withColumn("scaled", sp.standard_scale(F.col("close"), F.col("m"), F.col("s")))
    return out.withColumn("back", sp.standard_scale(F.col("scaled"), F.col("m"), F.col("s"), inverse=True))


@query("forward_logret", "entity:i horizon:i start_idx:i anchor_idx:i date:d target_date:d y_logret:f",
       "SELECT * FROM samp", [BARS, FOLD_ROWS, SAMPLES])
def forward_logret(spark, sf_dir):
    return sp.sample_index(bars(spark, sf_dir), LENGTH, HORIZONS)


@query("purged_split", "entity:i horizon:i anchor_idx:i fold:s split:s", "SELECT * FROM labelled", [BARS, FOLD_ROWS, SAMPLES])
def purged_split(spark, sf_dir):
    return sp.purged_split(sp.sample_index(bars(spark, sf_dir), LENGTH, HORIZONS), FOLDS)


@query("fold_range_join", "fold:s split:s horizon:i n:i first_anchor:d last_target:d",
       "SELECT fold, split, horizon, count(*) AS n, min(date) AS first_anchor, max(target_date) AS last_target FROM labelled GROUP BY 1, 2, 3",
       [BARS, FOLD_ROWS, SAMPLES])
def fold_range_join(spark, sf_dir):
    return purged_split(spark, sf_dir).groupBy("fold", "split", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_anchor"), F.max("target_date").alias("last_target"))


@query("anchor_split", "entity:i horizon:i anchor_idx:i fold:s split:s",
       """SELECT * FROM (SELECT entity, horizon, anchor_idx, fold, CASE WHEN date <= train_end THEN 'train' WHEN date BETWEEN val_start AND val_end THEN 'val'
  WHEN date BETWEEN test_start AND test_end THEN 'test' END AS split FROM samp, folds) z WHERE split IS NOT NULL""", [BARS, FOLD_ROWS, SAMPLES])
def anchor_split(spark, sf_dir):
    return sp.anchor_split(sp.sample_index(bars(spark, sf_dir), LENGTH, HORIZONS), FOLDS)


@query("entity_eligibility", "entity:i fold:s n_rows:i n_train:i n_train_samples:i",
       """SELECT a.entity, a.fold, n_rows, n_train, n_train_samples FROM (
  SELECT entity, fold, count(*) AS n_rows, count(*) FILTER (date <= train_end) AS n_train FROM bars, folds GROUP BY 1, 2) a JOIN (
  SELECT entity, fold, count(*) AS n_train_samples FROM labelled WHERE split = 'train' AND horizon = 4 GROUP BY 1, 2) b USING (entity, fold)
  WHERE n_rows >= 124 AND n_train >= 124""", [BARS, FOLD_ROWS, samples_sql(120, [4])])
def entity_eligibility(spark, sf_dir):
    return sp.eligible_entities(bars(spark, sf_dir), 120, 4, FOLDS)


@query("materialize_windows", "entity:i date:d n:i first_close:f last_close:f sum_close:f path_end:f",
       f"""SELECT entity, date, 12 AS n, a AS first_close, close AS last_close, s AS sum_close, p AS path_end FROM (
  SELECT entity, date, close, row_number() OVER w AS rn, lag(close, 11) OVER w AS a, sum(close) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS s,
    lead(close, 4) OVER w AS p FROM bars WINDOW w AS ({W})) q WHERE rn >= 12 AND p IS NOT NULL""", [BARS])
def materialize_windows(spark, sf_dir):
    out = sp.future_path(sp.windows(bars(spark, sf_dir), ["close", "volume"], 12), "close", 4)
    total = F.aggregate("x", F.lit(0.0), lambda acc, r: acc + r["close"])
    return out.select("entity", "date", F.size("x").alias("n"), F.col("x")[0]["close"].alias("first_close"),
                      F.col("x")[11]["close"].alias("last_close"), total.alias("sum_close"), F.col("y_path")[3].alias("path_end"))


@query("patches", "entity:i patch:i n:i first_value:f total:f",
       f"""SELECT entity, k AS patch, count(*) AS n, max(value) FILTER (i = k * 8) AS first_value, sum(value) AS total FROM (
  SELECT entity, i, value, n FROM padded) r, (SELECT unnest(generate_series(0, 1000)) AS k) g
  WHERE i BETWEEN k * 8 AND k * 8 + 15 AND k * 8 + 15 < n GROUP BY 1, 2""",
       [BARS, f"""series AS (SELECT entity, row_number() OVER ({W}) - 1 AS i, close AS value, count(*) OVER (PARTITION BY entity) AS n0 FROM bars),
padded AS (SELECT entity, i, value, n0 + 8 AS n FROM series UNION ALL SELECT entity, i + u, value, n0 + 8 FROM series, (SELECT unnest(generate_series(1, 8)) AS u) x WHERE i = n0 - 1)"""])
def patches(spark, sf_dir):
    out = sp.patches(bars(spark, sf_dir), "close", 16, 8, pad=True)
    return out.groupBy("entity", "patch").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("pos") == 0, F.col("value"))).alias("first_value"), F.sum("value").alias("total"))


@query("calendar_split_lookback", "entity:i date:d split:s is_context:b",
       f"""SELECT entity, date, 'train' AS split, false AS is_context FROM r WHERE rn <= v
  UNION ALL SELECT entity, date, 'val', rn <= v FROM r WHERE rn > v - 52 AND rn <= t
  UNION ALL SELECT entity, date, 'test', rn <= t FROM r WHERE rn > t - 52""",
       [BARS, f"""r AS (SELECT entity, date, row_number() OVER ({W}) AS rn, count(*) FILTER (date < DATE '2000-01-01') OVER (PARTITION BY entity) AS v,
  count(*) FILTER (date < DATE '2001-01-01') OVER (PARTITION BY entity) AS t FROM bars)"""])
def calendar_split_lookback(spark, sf_dir):
    return sp.calendar_split(bars(spark, sf_dir), Date(2000, 1, 1), Date(2001, 1, 1), 52)


@query("positional_panel", "mode:s entity:i pos:i date:d",
       """SELECT 'intersect' AS mode, entity, pos, date FROM p WHERE pos < (SELECT min(n) FROM (SELECT count(*) AS n FROM p GROUP BY entity) c)
  UNION ALL SELECT 'union', entity, pos, date FROM p""",
       [BARS, f"p AS (SELECT entity, date, row_number() OVER ({W}) - 1 AS pos FROM bars)"])
def positional_panel(spark, sf_dir):
    b = bars(spark, sf_dir)
    return sp.panel_by_position(b, "intersect").withColumn("mode", F.lit("intersect")).unionByName(
        sp.panel_by_position(b, "union").withColumn("mode", F.lit("union")))


@query("calendar_panel", "year:i date:d entity:i price:f discount:f",
       """SELECT year(l_shipdate) AS year, CAST(l_shipdate AS DATE) AS date, l_suppkey AS entity,
  arg_max(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS price,
  arg_max(l_discount, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS discount FROM lineitem GROUP BY 1, 2, 3""")
def calendar_panel(spark, sf_dir):
    from barweave.plans.fixtures import table
    li = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("entity"),
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), "l_quantity", F.col("l_discount").alias("discount"))
    return sp.calendar_panel(li, ["year"], ["l_orderkey", "l_linenumber", "l_partkey", "price", "l_quantity"])
