"""Queries: news coverage, price diagnostics, curation, audits and sampling."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators import quality as ql
from barweave.operators import sentiment as st
from barweave.operators import universe as un
from barweave.operators.splits import fit_minmax, apply_minmax, fold_table
from barweave.plans.fixtures import (
    ARTICLES, BARS, COUNTS, CURATION, DAILY, DAY_BARS, EVENT_BARS, FOLDS, articles, bars, event_bars, news, table,
)
from barweave.plans.registry import query
from barweave.plans.rolling import MERGED, SENTIMENT, W, merged_bars, sql_corr
from barweave.plans.tables import CHOSEN, SCORED_TEXTS, TEXTS, scored_texts

YEARS = CURATION.coverage_years
COVERAGE = "coverage AS (SELECT entity, sum(n) AS n_total, " + ", ".join(
    f"coalesce(sum(n) FILTER (year = {y}), 0) AS n_{y}" for y in YEARS) + " FROM counts GROUP BY 1)"


def counts(spark, sf_dir):
    return un.news_counts(news(spark, sf_dir))


def coverage(spark, sf_dir):
    return un.news_coverage(counts(spark, sf_dir), YEARS)


@query("news_counts_by_year", "entity:i year:i n:i", "SELECT * FROM counts", [COUNTS])
def news_counts(spark, sf_dir):
    return counts(spark, sf_dir)


@query("news_year_pivot", "entity:i n_total:i " + " ".join(f"n_{y}:i" for y in YEARS), "SELECT * FROM coverage", [COUNTS, COVERAGE])
def news_year_pivot(spark, sf_dir):
    return coverage(spark, sf_dir)


def wide_universe(spark, sf_dir) -> DataFrame:
    """Customer numbers as a universe in which only those that are supplier numbers too have news and bars."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))


@query("coverage_buckets", "entity:i n_pre1997:i n_1997:i n_1998:i n_1999:i n_2000:i n_2001:i n_total:i",
       "SELECT c_custkey AS entity, coalesce(sum(n) FILTER (year < 1997), 0) AS n_pre1997, "
       + ", ".join(f"coalesce(sum(n) FILTER (year = {y}), 0) AS n_{y}" for y in range(1997, 2002))
       + ", coalesce(sum(n), 0) AS n_total FROM customer LEFT JOIN counts ON entity = c_custkey GROUP BY 1",
       [COUNTS])
def coverage_buckets(spark, sf_dir):
    return un.coverage_buckets(wide_universe(spark, sf_dir), counts(spark, sf_dir), 1997, list(range(1997, 2002)))


@query("median_dollar_volume", "entity:i n_rows:i median_dollar_vol:f",
       "SELECT entity, count(*) AS n_rows, median(close * volume) AS median_dollar_vol FROM bars WHERE year(date) = 1997 GROUP BY 1 HAVING count(*) >= 76",
       [DAY_BARS])
def median_dollar_volume(spark, sf_dir):
    return un.median_dollar_volume(bars(spark, sf_dir, "day"), 1997, 76)


@query("max_gap_days", "entity:i max_gap_days:i",
       f"""SELECT entity, coalesce(max(date_diff('day', p, date)), 99) AS max_gap_days FROM (
  SELECT entity, date, lag(date) OVER ({W}) AS p FROM bars) b GROUP BY 1""", [DAY_BARS])
def max_gap_days(spark, sf_dir):
    return un.max_gap_days(bars(spark, sf_dir, "day"))


NEWS_PASS = """news_pass AS (
  SELECT entity, coalesce(sum(n) FILTER (year = 1996), 0) AS n_a, coalesce(sum(n) FILTER (year = 1997), 0) AS n_b
  FROM counts GROUP BY 1 HAVING coalesce(sum(n) FILTER (year = 1996), 0) >= 70 AND coalesce(sum(n) FILTER (year = 1997), 0) >= 70)"""
INSIDE = "date BETWEEN DATE '1995-01-20' AND DATE '2001-10-31'"
LIQUID = f"({INSIDE} AND year(date) = 1997)"
DIAGNOSED = f"""diagnosed AS (
  SELECT *, CASE WHEN n_rows < 100 THEN 'too_short' WHEN price_start > DATE '1995-01-20' THEN 'starts_too_late'
    WHEN price_end < DATE '2001-10-31' - 14 THEN 'ends_too_early' WHEN n_price_rows < 200 THEN 'in_window_too_short'
    WHEN nl < 40 THEN 'no_1997_data' WHEN sd < 1e-3 * close_liquidity_mean THEN 'constant_liquidity_close' END AS error FROM (
    SELECT entity, count(*) AS n_rows, min(date) AS price_start, max(date) AS price_end, count(*) FILTER ({INSIDE}) AS n_price_rows,
      coalesce(max(date_diff('day', p, date)) FILTER ({INSIDE}), 99) AS max_gap_days, count(*) FILTER ({LIQUID}) AS nl,
      median(close * volume) FILTER ({LIQUID}) AS median_dollar_vol, stddev_samp(close) FILTER ({LIQUID}) AS sd,
      avg(close) FILTER ({LIQUID}) AS close_liquidity_mean
    FROM (SELECT *, CASE WHEN {INSIDE} THEN lag(CASE WHEN {INSIDE} THEN date END) OVER ({W}) END AS p FROM bars) b GROUP BY 1) d)"""
CURATED = """passed AS (
  SELECT n.entity, n_a, n_b, n_a + n_b AS selection_news, median_dollar_vol, max_gap_days FROM news_pass n JOIN diagnosed d USING (entity)
  WHERE error IS NULL AND max_gap_days <= 28 AND median_dollar_vol >= 1e6),
tiered AS (
  SELECT *, CASE WHEN selection_news >= (SELECT quantile_cont(CAST(selection_news AS DOUBLE), 0.75) FROM passed) THEN 'STRONG'
    WHEN selection_news >= (SELECT quantile_cont(CAST(selection_news AS DOUBLE), 0.25) FROM passed) THEN 'MEDIUM' ELSE 'WEAK' END AS tier,
    ln(1 + n_b) + 0.5 * ln(1 + n_a) + 0.2 * log10(greatest(median_dollar_vol, 1)) AS composite_score FROM passed),
curated AS (SELECT * FROM tiered ORDER BY composite_score DESC, entity LIMIT 300)"""
CURATE_CTES = [COUNTS, NEWS_PASS, BARS, DIAGNOSED, CURATED]


@query("price_diagnostics", "entity:i n_rows:i price_start:d price_end:d n_price_rows:i max_gap_days:i median_dollar_vol:f close_liquidity_mean:f error:s",
       "SELECT * FROM diagnosed", [BARS, DIAGNOSED])
def price_diagnostics(spark, sf_dir):
    return un.price_diagnostics(bars(spark, sf_dir), CURATION)


@query("universe_intersect", "entity:i n_a:i n_b:i median_dollar_vol:f", "SELECT * FROM passed", CURATE_CTES)
def universe_intersect(spark, sf_dir):
    passed = un.news_passing(counts(spark, sf_dir), CURATION)
    return passed.join(un.price_passing(bars(spark, sf_dir), CURATION), "entity", "inner")


def candidates(spark, sf_dir):
    return universe_intersect(spark, sf_dir).withColumn("selection_news", F.col("n_a") + F.col("n_b"))


@query("quantile_tiers", "entity:i selection_news:i tier:s", "SELECT * FROM tiered", CURATE_CTES)
def quantile_tiers(spark, sf_dir):
    return un.tier(candidates(spark, sf_dir))


@query("composite_topn", "entity:i composite_score:f", "SELECT * FROM tiered ORDER BY composite_score DESC, entity LIMIT 10", CURATE_CTES)
def composite_topn(spark, sf_dir):
    return un.composite_topn(candidates(spark, sf_dir), "n_a", "n_b", 10)


@query("curate_universe", "entity:i n_a:i n_b:i selection_news:i tier:s composite_score:f max_gap_days:i", "SELECT * FROM curated", CURATE_CTES)
def curate_universe(spark, sf_dir):
    return un.curate_universe(news(spark, sf_dir), bars(spark, sf_dir), CURATION)


@query("seeded_subset", "entity:i tier:s",
       """SELECT * FROM curated ORDER BY CASE WHEN tier = 'STRONG' THEN 0 ELSE 1 END, CASE WHEN tier = 'STRONG' THEN md5('2026|' || entity) END,
  CASE WHEN tier <> 'STRONG' THEN composite_score END DESC, entity LIMIT 12""", CURATE_CTES)
def seeded_subset(spark, sf_dir):
    return un.seeded_subset(un.curate_universe(news(spark, sf_dir), bars(spark, sf_dir), CURATION), 12)


@query("article_sample", "sample:s article_id:i",
       """SELECT 'articles' AS sample, article_id FROM (SELECT article_id FROM articles ORDER BY md5('2026|' || article_id), article_id LIMIT 40) a
  UNION ALL SELECT 'entities', article_id FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, article_id) AS rn FROM articles
    WHERE entity IN (SELECT entity FROM (SELECT DISTINCT entity FROM articles) ORDER BY md5('2026|' || entity), entity LIMIT 8)) b WHERE rn <= 5""",
       [ARTICLES])
def article_sample(spark, sf_dir):
    a = articles(spark, sf_dir)
    drawn = un.article_sample(a, 40).select(F.lit("articles").alias("sample"), "article_id")
    return drawn.unionByName(un.entity_sample(a, 8, 5).select(F.lit("entities").alias("sample"), "article_id"))


@query("coverage_stats", "metric:s n:i median:f p10:f p90:f",
       " UNION ALL ".join(
           f"SELECT 'n_{y}' AS metric, count(*) AS n, quantile_cont(CAST(n_{y} AS DOUBLE), 0.5) AS median, quantile_cont(CAST(n_{y} AS DOUBLE), 0.1) AS p10, "
           f"quantile_cont(CAST(n_{y} AS DOUBLE), 0.9) AS p90 FROM coverage" for y in YEARS), [COUNTS, COVERAGE])
def coverage_stats(spark, sf_dir):
    return un.coverage_stats(coverage(spark, sf_dir), [f"n_{y}" for y in YEARS])


@query("fold_shortfalls", "fold:s bad_val:i bad_test:i",
       " UNION ALL ".join(f"SELECT '{f.name}' AS fold, count(*) FILTER (n_{f.val_year} < 80) AS bad_val, count(*) FILTER (n_{f.test_year} < 80) AS bad_test FROM coverage" for f in FOLDS),
       [COUNTS, COVERAGE])
def fold_shortfalls(spark, sf_dir):
    return un.fold_shortfalls(coverage(spark, sf_dir), FOLDS, 80)


CHECKS = [("year_1996", 1996, 70), ("year_1997", 1997, 70)] + [
    (f"{f.name}_{p}", y, 80) for f in FOLDS for p, y in (("val", f.val_year), ("test", f.test_year))]


@query("check_coverage", 'check:s n_bad:i passed:b'.replace("check:s", "check_name:s"),
       " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER (n_{y} < {m}) AS n_bad, count(*) FILTER (n_{y} < {m}) = 0 AS passed FROM coverage"
                          for k, y, m in CHECKS), [COUNTS, COVERAGE])
def check_coverage(spark, sf_dir):
    out = ql.check_coverage(coverage(spark, sf_dir), [1996, 1997], FOLDS, 70, 80)
    return out.withColumnRenamed("check", "check_name")


# Folds of all years of the data, bent by the number of trades in the train-end year: validation starts late for some, the test
# begins inside validation for others, so both answers occur.
BENT = """bent AS (SELECT 'F' || (y - lo + 1) AS fold, make_date(y, 12, 31) AS train_end, make_date(y + 1, 1, 1) + CAST(n % 3 AS INTEGER) AS val_start,
  make_date(y + 1, 12, 31) AS val_end, make_date(y + 2, 1, 1) - CAST(n % 2 AS INTEGER) AS test_start
  FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, count(*) AS n, min(CAST(year(l_shipdate) AS INTEGER)) OVER () AS lo FROM lineitem GROUP BY 1) t
  WHERE y <= (SELECT max(year(l_shipdate)) - 2 FROM lineitem))"""


@query("check_calendar", "fold:s train_before_val:b val_before_test:b train_gap_one_day:b val_gap_one_day:b passed:b",
       """SELECT *, train_before_val AND val_before_test AND train_gap_one_day AND val_gap_one_day AS passed FROM (
  SELECT fold, train_end < val_start AS train_before_val, val_end < test_start AS val_before_test, date_diff('day', train_end, val_start) = 1 AS train_gap_one_day,
    date_diff('day', val_end, test_start) = 1 AS val_gap_one_day FROM bent) c""", [BENT])
def check_calendar(spark, sf_dir):
    years = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    folds = fold_table(years, 1).withColumn("year", F.year("train_end")).join(years, "year")
    return ql.check_calendar(folds.withColumns({
        "val_start": F.date_add("val_start", (F.col("n") % 3).cast("int")), "test_start": F.date_sub("test_start", (F.col("n") % 2).cast("int"))}))


@query("check_price_range", "entity:i first_date:d last_date:d status:s",
       """SELECT c_custkey AS entity, first_date, last_date, CASE WHEN first_date IS NULL THEN 'missing' WHEN first_date > DATE '1995-01-15' THEN 'starts_late'
  WHEN last_date < DATE '2001-10-25' THEN 'ends_early' ELSE 'ok' END AS status FROM customer LEFT JOIN (
  SELECT entity, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1) b ON entity = c_custkey""", [DAY_BARS])
def check_price_range(spark, sf_dir):
    return ql.check_price_range(wide_universe(spark, sf_dir), bars(spark, sf_dir, "day"), Date(1995, 1, 15), Date(2001, 10, 25))


# ---- article, daily and merged audits ------------------------------------------------

def join_failures(**tests: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items()) + ")"


UNIFORM = " AND ".join(f"{p} BETWEEN 0.32 AND 0.34" for p in ("positive_prob", "negative_prob", "neutral_prob"))
THIRD = " AND ".join(f"abs({p} - 1.0 / 3.0) < 0.01" for p in ("positive_prob", "negative_prob", "neutral_prob"))


@query("audit_articles", "entity:i n:i sd_positive:f uniform_share:f failures:s",
       f"""SELECT *, {join_failures(empty='n = 0', flat='sd_positive < 1e-3', uniform='uniform_share > 0.05')} AS failures FROM (
  SELECT entity, count(positive_prob) AS n, stddev_samp(positive_prob) AS sd_positive, avg(CASE WHEN {UNIFORM} THEN 1.0::DOUBLE ELSE 0 END) AS uniform_share
  FROM articles GROUP BY 1) a""", [ARTICLES])
def audit_articles(spark, sf_dir):
    return ql.audit_articles(articles(spark, sf_dir)).withColumn("failures", F.concat_ws(",", "failures"))


BLOCK_AGGS = f"""count(*) AS n, max(abs(positive_prob + negative_prob + neutral_prob - 1.0)) AS max_sum_error, stddev_pop(positive_prob) AS sd_positive,
  avg(CASE WHEN {THIRD} THEN 1.0::DOUBLE ELSE 0 END) AS uniform_share"""
BLOCK_FAILURES = join_failures(sum="max_sum_error > 1e-3", flat="sd_positive < 1e-3", uniform="uniform_share > 0.05")


@query("audit_block", "entity:i block:i n:i max_sum_error:f sd_positive:f uniform_share:f failures:s",
       f"""SELECT *, {BLOCK_FAILURES} AS failures FROM (SELECT entity, idx // 16 AS block, {BLOCK_AGGS} FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, article_id) - 1 AS idx FROM articles) a GROUP BY 1, 2) b""", [ARTICLES])
def audit_block(spark, sf_dir):
    return ql.audit_blocks(articles(spark, sf_dir), 16).withColumn("failures", F.concat_ws(",", "failures"))


@query("audit_daily", "entity:i n_days:i sd_scaled:f max_sum_error:f duplicates:i failures:s",
       f"""SELECT *, {join_failures(flat='sd_scaled < 0.02', sum='max_sum_error > 1e-3', duplicate='duplicates > 0')} AS failures FROM (
  SELECT entity, count(*) AS n_days, stddev_samp(scaled_sentiment) AS sd_scaled, max(abs(avg_positive + avg_negative + avg_neutral - 1)) AS max_sum_error,
    count(*) - count(DISTINCT date) AS duplicates FROM (SELECT * FROM daily UNION ALL SELECT * FROM daily WHERE entity % 10 = 0) u GROUP BY 1) d""",
       [ARTICLES, DAILY])
def audit_daily(spark, sf_dir):
    d = st.daily_sentiment(articles(spark, sf_dir))
    twice = d.unionByName(d.where(F.col("entity") % 10 == 0))
    return ql.audit_daily(twice).withColumn("failures", F.concat_ws(",", "failures"))


@query("audit_merged", "entity:i n_bars:i n_merged:i sd_scaled:f failures:s",
       f"""SELECT *, {join_failures(row_count='n_bars IS DISTINCT FROM n_merged', flat='sd_scaled < 0.02')} AS failures FROM (
  SELECT entity, count(*) AS n_bars FROM event_bars GROUP BY 1) a FULL JOIN (
  SELECT entity, count(*) AS n_merged, stddev_samp(sent) AS sd_scaled FROM faded GROUP BY 1) b USING (entity)""", SENTIMENT)
def audit_merged(spark, sf_dir):
    out = ql.audit_merged(event_bars(spark, sf_dir), merged_bars(spark, sf_dir))
    return out.withColumn("failures", F.concat_ws(",", "failures"))


@query("audit_entity", "entity:i n:i sd:f time_corr:f status:s",
       f"""SELECT *, CASE WHEN sd < 0.02 OR abs(time_corr) > 0.6 THEN 'FAIL' WHEN sd < 0.05 THEN 'WARN' ELSE 'OK' END AS status FROM (
  SELECT entity, count(*) AS n, stddev_samp(sent) AS sd, {sql_corr('i', 'sent', '')} AS time_corr FROM (
    SELECT entity, sent, CAST(row_number() OVER ({W}) AS DOUBLE) AS i FROM faded) f GROUP BY 1) g WHERE n >= 20""", SENTIMENT)
def audit_entity(spark, sf_dir):
    return ql.audit_entity(merged_bars(spark, sf_dir), min_rows=20)


@query("audit_cache", "entity:i sd:f failed:b",
       """SELECT entity, stddev_pop(mm) AS sd, stddev_pop(mm) < 1e-3 AS failed FROM (
  SELECT entity, (sent - min(sent) OVER e) / CASE WHEN max(sent) OVER e = min(sent) OVER e THEN 1 ELSE max(sent) OVER e - min(sent) OVER e END AS mm
  FROM faded WINDOW e AS (PARTITION BY entity)) q GROUP BY 1""", SENTIMENT)
def audit_cache(spark, sf_dir):
    m = merged_bars(spark, sf_dir)
    scaled = apply_minmax(m, fit_minmax(m, ["scaled_sentiment"]), ["scaled_sentiment"])
    return ql.audit_cache(scaled, None, "mm_scaled_sentiment")


@query("cross_entity_variance", "n_entities:i sd_means:f passed:b",
       """SELECT count(*) AS n_entities, stddev_pop(m) AS sd_means, count(*) >= 3 AND stddev_pop(m) >= 0.02 AS passed FROM (
  SELECT entity, avg(composite_score) AS m FROM articles GROUP BY 1) a""", [ARTICLES])
def cross_entity_variance(spark, sf_dir):
    return ql.cross_entity_variance(articles(spark, sf_dir))


@query("labelled_sanity", "n_labelled:i n_right:i passed:b",
       """SELECT count(*) AS n_labelled, count(*) FILTER (p > 0.4) AS n_right, count(*) FILTER (p > 0.4) >= 0.75 * count(*) AS passed FROM (
  SELECT CASE WHEN quality = 1 THEN positive_prob ELSE negative_prob END AS p FROM scored JOIN labels ON doc_id = article_id) q""",
       [TEXTS, CHOSEN, SCORED_TEXTS])
def labelled_sanity(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("article_id"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))
    return ql.labelled_sanity(scored_texts(spark, sf_dir).join(labels, "article_id"), above=0.4)
