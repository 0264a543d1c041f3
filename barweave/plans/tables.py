"""Queries: scans, sinks, text selection, simple predicates and joins."""

from __future__ import annotations

import math
from datetime import date as Date

import pandas as pd
from pyspark.sql import functions as F

from barweave.functions import norm_symbol, select_text, text_source, utc_day, utc_day_text
from barweave.functions.text import WHITE_SPACE
from barweave.operators import report as rp
from barweave.operators import sentiment as st
from barweave.operators import universe as un
from barweave.operators.inference import lag_pairs
from barweave.operators.portfolio import panel_rows
from barweave.plans.fixtures import ARTICLES, BARS, DAY_BARS, articles, bars, table
from barweave.plans.registry import query
from barweave.session import scratch_path
from barweave.sources import manifest, read_news, read_prices, unpivot_panel, write_by_entity
from barweave.sources.writers import refresh_cache, write_cache


def texts(spark, sf_dir):
    """Documents as raw articles: every 7th body is line ends and blanks only, every 14th has no title either."""
    d = table(spark, sf_dir, "documents")
    blank, bare = F.col("doc_id") % 7 == 0, F.col("doc_id") % 14 == 0
    return d.select(
        F.col("doc_id").alias("article_id"), F.col("source").alias("entity"),
        F.when(bare, " ").otherwise(F.concat_ws(" ", "source", "lang", "doc_id")).alias("title"),
        F.when(blank, "\n \t" * 30).otherwise(F.col("text")).alias("body"))


TEXTS = """texts AS (
  SELECT doc_id AS article_id, source AS entity, CASE WHEN doc_id % 14 = 0 THEN ' ' ELSE source || ' ' || lang || ' ' || doc_id END AS title,
    CASE WHEN doc_id % 7 = 0 THEN repeat(chr(10) || ' ' || chr(9), 30) ELSE text END AS body FROM documents)"""
WHITE = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
CHOSEN = f"""chosen AS (
  SELECT *, CASE text_source WHEN 'article' THEN body WHEN 'title' THEN title ELSE '' END AS text_used FROM (
    SELECT *, CASE WHEN length(trim(body, {WHITE})) > 50 THEN 'article' WHEN length(trim(title, {WHITE})) > 0 THEN 'title' ELSE 'empty' END AS text_source FROM texts) t)"""


@query("scan_news", "entity:s day:d publisher:s n:i",
       """SELECT upper(source) AS entity, DATE '2020-01-01' + CAST(doc_id % 700 AS INTEGER) AS day, lang AS publisher, count(*) AS n
  FROM documents WHERE doc_id % 10 <> 3 GROUP BY 1, 2, 3""")
def scan_news(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit(Date(2020, 1, 1)), (F.col("doc_id") % 700).cast("int")).cast("string")
    stamp = F.when(F.col("doc_id") % 10 == 3, "n/a").when(F.col("doc_id") % 2 == 0, F.concat(day, F.lit(" 11:30:00 UTC"))) \
        .otherwise(F.concat(day, F.lit(" 11:30:00+00:00")))
    raw = d.select(F.col("doc_id").alias("Unnamed: 0"), F.col("lang").alias("publisher"), F.col("text").alias("Article"),
                   F.concat(F.lit(" \n"), "source").alias("Stock_symbol"), F.col("source").alias("Article_title"),
                   stamp.alias("Date"), F.lit("-").alias("Lsa_summary"))
    path = scratch_path(spark, "news")
    raw.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    out = read_news(spark, path)
    return out.groupBy("entity", utc_day("ts").alias("day"), "publisher").agg(F.count(F.lit(1)).alias("n"))


@query("scan_prices", "entity:i n:i first_date:d last_date:d sum_close:f sum_adj:f",
       "SELECT entity, count(*) AS n, min(date) AS first_date, max(date) AS last_date, sum(close) AS sum_close, sum(adj_close) AS sum_adj FROM bars GROUP BY 1",
       [BARS])
def scan_prices(spark, sf_dir):
    path = scratch_path(spark, "prices")
    raw = bars(spark, sf_dir).select("entity", F.col("volume").alias("Volume"), F.lit("x").alias("note"), F.col("adj_close").alias("Adj Close"),
                                     F.col("close").alias("Close"), "low", "high", "open", F.col("date").alias("Date"))
    layouts = [raw.columns, list(reversed(raw.columns)), ["date", "entity", "open", "high", "low", "Close", "Adj Close", "Volume"]]
    for k, names in enumerate(layouts):
        # Three header orders among the files of one folder, one of them without the unused column.
        renamed = raw.withColumnRenamed("Date", "date") if "date" in names else raw
        part = renamed.where(F.col("entity") % len(layouts) == k).select(*names)
        # A file per entity: tasks move their own files in place, the driver would move them one by one.
        dealt = part.repartition("entity").write.mode("append").partitionBy("entity").option("header", True)
        dealt.option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(path)
    out = read_prices(spark, path, stem=r"entity=([^/]+)/")
    return out.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum("close").alias("sum_close"), F.sum("adj_close").alias("sum_adj"))


def some_universe(spark, sf_dir):
    """Sources whose documents are at least 62 % English."""
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("entity"))
    share = d.agg(F.count_if(F.col("lang") == "en").alias("en"), F.count(F.lit(1)).alias("n"))
    return share.where(F.col("en") * 100 >= F.col("n") * 62).select("entity")


UNIVERSE = "universe AS (SELECT source AS entity FROM documents GROUP BY 1 HAVING count(*) FILTER (lang = 'en') * 100 >= count(*) * 62)"


@query("filter_news_to_universe", "article_id:i entity:s n_chars:i digest:s",
       "SELECT article_id, upper(entity) AS entity, length(body) AS n_chars, md5(body) AS digest FROM texts WHERE entity IN (SELECT entity FROM universe)",
       [TEXTS, UNIVERSE])
def filter_news(spark, sf_dir):
    kept = un.prefilter(texts(spark, sf_dir), some_universe(spark, sf_dir))
    return kept.withColumns({"n_chars": F.length("body"), "digest": F.md5("body")})


@query("write_partitioned", "entity:i date:d close:f", "SELECT entity, date, close FROM bars", [BARS])
def write_partitioned(spark, sf_dir):
    path = scratch_path(spark, "by-entity")
    write_by_entity(bars(spark, sf_dir), path, buckets=16, time_slices=4)
    return spark.read.parquet(path)


@query("stage_manifest", "entity:i n_rows:i first_date:d last_date:d mean_value:f sd_value:f failures:s status:s",
       """SELECT *, CASE WHEN failures = '' THEN 'ok' ELSE 'failed' END AS status FROM (SELECT entity, count(*) AS n_rows, min(date) AS first_date,
  max(date) AS last_date, avg(scaled_sentiment) AS mean_value, stddev_samp(scaled_sentiment) AS sd_value,
  CASE WHEN stddev_samp(scaled_sentiment) < 0.35 THEN 'flat' ELSE '' END AS failures
  FROM (SELECT *, CAST(ts AS DATE) AS date FROM articles) a GROUP BY 1) m""", [ARTICLES])
def stage_manifest(spark, sf_dir):
    out = manifest(articles(spark, sf_dir).withColumn("date", utc_day("ts")), "scaled_sentiment", min_sd=0.35)
    return out.withColumn("failures", F.concat_ws(",", "failures"))


@query("upsert_results", "entity:i year:i n:i origin:s",
       """SELECT l_suppkey AS entity, year(l_shipdate) AS year, count(*) AS n, 'old' AS origin FROM lineitem
  WHERE NOT (year(l_shipdate) >= 1999 AND l_suppkey % 2 = 0) GROUP BY 1, 2
  UNION ALL SELECT l_suppkey, year(l_shipdate), count(*), 'new' FROM lineitem WHERE year(l_shipdate) >= 1999 AND l_suppkey % 2 = 0 GROUP BY 1, 2""")
def upsert_results(spark, sf_dir):
    existing, new = two_versions(spark, sf_dir)
    return rp.upsert(existing, new, ["entity", "year"])


def two_versions(spark, sf_dir):
    """Yearly counts per supplier, and a newer version of the even suppliers' later years."""
    li = table(spark, sf_dir, "lineitem")
    counts = li.groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    newer = counts.where((F.col("year") >= 1999) & (F.col("entity") % 2 == 0)).withColumn("origin", F.lit("new"))
    return counts.withColumn("origin", F.lit("old")), newer


@query("upsert_repeats", "entity:i year:i n:i revision:i",
       """WITH old AS (SELECT l_suppkey AS entity, nullif(year(l_shipdate), 1992) AS year, count(*) AS n FROM lineitem GROUP BY 1, 2),
  news AS (SELECT entity, year, n + r AS n, r AS revision FROM old, (SELECT unnest([1, 2, 3]) AS r) g WHERE entity % 2 = 0 AND (year IS NULL OR year >= 1997) AND (r < 3 OR entity % 4 = 0))
  SELECT entity, year, n, 0 AS revision FROM old WHERE NOT (entity % 2 = 0 AND (year IS NULL OR year >= 1997))
  UNION ALL SELECT entity, year, n, revision FROM news QUALIFY row_number() OVER (PARTITION BY entity, year ORDER BY revision DESC) = 1""")
def upsert_repeats(spark, sf_dir):
    """Null keys, and up to three revisions of a key among the new rows: the last one stays."""
    li = table(spark, sf_dir, "lineitem")
    year = F.nullif(F.year("l_shipdate"), F.lit(1992))
    old = li.groupBy(F.col("l_suppkey").alias("entity"), year.alias("year")).agg(F.count(F.lit(1)).alias("n")).withColumn("revision", F.lit(0))
    again = old.where((F.col("entity") % 2 == 0) & (F.col("year").isNull() | (F.col("year") >= 1997)))
    new = again.withColumn("revision", F.explode(F.when(F.col("entity") % 4 == 0, F.array(*[F.lit(r) for r in (1, 2, 3)])).otherwise(F.array(F.lit(1), F.lit(2)))))
    return rp.upsert(old, new.withColumn("n", F.col("n") + F.col("revision")), ["entity", "year"], order="revision")


@query("anti_join_replace", "entity:i year:i n:i",
       """SELECT l_suppkey AS entity, year(l_shipdate) AS year, count(*) AS n FROM lineitem
  WHERE NOT (year(l_shipdate) >= 1999 AND l_suppkey % 2 = 0) GROUP BY 1, 2""")
def anti_join_replace(spark, sf_dir):
    existing, new = two_versions(spark, sf_dir)
    return existing.join(new.select("entity", "year"), ["entity", "year"], "left_anti")


WIDE = """SELECT date_trunc('week', l_shipdate) AS date, l_returnflag AS entity, avg(l_discount) AS pred, avg(l_tax) AS actual
  FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1, 2"""


@query("panel_csv_unpivot", "date:d entity:s pred:f actual:f", WIDE)
def panel_csv_unpivot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cols = []
    for flag in ("A", "N", "R"):
        on = F.col("l_returnflag") == flag
        cols += [F.avg(F.when(on, F.col("l_discount"))).alias(f"pred_{flag}"), F.avg(F.when(on, F.col("l_tax"))).alias(f"actual_{flag}")]
    wide = li.groupBy(F.date_trunc("week", "l_shipdate").alias("date")).agg(*cols, F.count(F.lit(1)).alias("pred_rows"))
    return unpivot_panel(wide).where(F.col("pred").isNotNull() | F.col("actual").isNotNull())


@query("scaled_cache", "entity:i date:d mm_close:f mm_volume:f rebuilt:b",
       """SELECT entity, date, (close - min(close) OVER e) / CASE WHEN max(close) OVER e = min(close) OVER e THEN 1 ELSE max(close) OVER e - min(close) OVER e END AS mm_close,
  (volume - min(volume) OVER e) / CASE WHEN max(volume) OVER e = min(volume) OVER e THEN 1 ELSE max(volume) OVER e - min(volume) OVER e END AS mm_volume,
  entity % 4 <> 0 AS rebuilt FROM bars WINDOW e AS (PARTITION BY entity)""", [BARS])
def scaled_cache(spark, sf_dir):
    """A stored cache in which odd entities are outdated and every fourth is missing, brought up to date."""
    b = bars(spark, sf_dir)
    val, test, older, cols = Date(2000, 1, 1), Date(2001, 1, 1), Date(1999, 1, 1), ["close", "volume"]
    part = F.col("entity") % 4
    fresh = write_cache(b.where(part == 0), scratch_path(spark, "cache"), cols, val, test)
    old = write_cache(b.where(part.isin(1, 3)), scratch_path(spark, "cache"), cols, older, test)
    return refresh_cache(b, fresh.unionByName(old), scratch_path(spark, "cache"), cols, val, test)


# ---- expressions ------------------------------------------------------------------

@query("normalize_symbol", "s_suppkey:i symbol:s kept:s",
       "SELECT s_suppkey, upper(trim(' ' || lower(s_name) || '  ')) AS symbol, upper(' ' || lower(s_name) || '  ') AS kept FROM supplier")
def normalize_symbol(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.lower("s_name"), F.lit("  "))
    return table(spark, sf_dir, "supplier").select("s_suppkey", norm_symbol(raw).alias("symbol"), norm_symbol(raw, trimmed=False).alias("kept"))


@query("floor_to_utc_day", "event_id:i day:d day_text:s",
       "SELECT event_id, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m-%d') || ' 00:00:00+00:00' AS day_text FROM events")
def floor_to_utc_day(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", utc_day("ts").alias("day"), utc_day_text("ts").alias("day_text"))


@query("date_window_filter", "entity:i date:d close:f",
       "SELECT entity, date, close FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-27'", [BARS])
def date_window_filter(spark, sf_dir):
    return bars(spark, sf_dir).where(F.col("date").between(Date(1996, 1, 1), Date(1999, 12, 27)))


@query("select_text", "article_id:i text_source:s n_chars:i digest:s",
       "SELECT article_id, text_source, length(text_used) AS n_chars, md5(text_used) AS digest FROM chosen WHERE text_source <> 'empty'",
       [TEXTS, CHOSEN])
def choose_text(spark, sf_dir):
    return st.with_text(texts(spark, sf_dir)).withColumns({"n_chars": F.length("text_used"), "digest": F.md5("text_used")})


SCORED_TEXTS = """tokens AS (
  SELECT article_id, entity, list_filter(string_split_regex(lower(text_used), '[^\\p{L}]+'), lambda t: t <> '') AS tk FROM chosen WHERE text_source <> 'empty'),
logits AS (
  SELECT article_id, entity, len(tk) AS n_tokens,
    exp(len(list_filter(tk, lambda t: t IN (POS))) / greatest(sqrt(len(tk)), 1.0)) AS ep,
    exp(len(list_filter(tk, lambda t: t IN (NEG))) / greatest(sqrt(len(tk)), 1.0)) AS en FROM tokens),
scored AS (
  SELECT article_id, entity, n_tokens, ep / (ep + en + 1) AS positive_prob, en / (ep + en + 1) AS negative_prob, 1 / (ep + en + 1) AS neutral_prob,
    (ep - en) / (ep + en + 1) AS composite_score FROM logits)"""
# Frequent words of the sample texts standing in for a polarity list.
DEMO_POSITIVE = ["der", "que", "les", "the", "and", "of"]
DEMO_NEGATIVE = ["la", "un", "die", "to", "in", "is"]
quoted = lambda words: ", ".join(f"'{w}'" for w in words)
SCORED_TEXTS = SCORED_TEXTS.replace("POS", quoted(DEMO_POSITIVE)).replace("NEG", quoted(DEMO_NEGATIVE))


def scored_texts(spark, sf_dir):
    return st.score_articles(st.with_text(texts(spark, sf_dir)), positive=DEMO_POSITIVE, negative=DEMO_NEGATIVE)


@query("score_articles", "article_id:i n_tokens:i positive_prob:f negative_prob:f neutral_prob:f composite_score:f",
       "SELECT * FROM scored", [TEXTS, CHOSEN, SCORED_TEXTS])
def score_articles(spark, sf_dir):
    return scored_texts(spark, sf_dir)


def word_scorer():
    """A scorer as a user would bring one: made once in each task, then handed lists of texts."""
    import regex

    letters = regex.compile(r"\p{L}+")

    def score(list_of_texts):
        rows = []
        for text in list_of_texts:
            words = letters.findall(text.lower())
            scale = max(len(words) ** 0.5, 1.0)
            up, down = (math.exp(sum(w in listed for w in words) / scale) for listed in (DEMO_POSITIVE, DEMO_NEGATIVE))
            rows.append((len(words), up / (up + down + 1.0), down / (up + down + 1.0), 1.0 / (up + down + 1.0)))
        return pd.DataFrame(rows, columns=["n_tokens", *st.PROBS])

    return score


@query("score_articles_loaded", "article_id:i n_tokens:i positive_prob:f negative_prob:f neutral_prob:f composite_score:f",
       "SELECT * FROM scored", [TEXTS, CHOSEN, SCORED_TEXTS])
def score_articles_loaded(spark, sf_dir):
    return st.score_articles(st.with_text(texts(spark, sf_dir)), load=word_scorer, batch=64)


# ---- joins ---------------------------------------------------------------------------

@query("semi_join_universe", "article_id:i entity:s",
       "SELECT article_id, entity FROM texts WHERE entity IN (SELECT entity FROM universe)", [TEXTS, UNIVERSE])
def semi_join(spark, sf_dir):
    return un.semi_join_universe(texts(spark, sf_dir), some_universe(spark, sf_dir))


@query("existence_check", "entity:s", "SELECT DISTINCT entity FROM texts WHERE entity NOT IN (SELECT entity FROM universe)",
       [TEXTS, UNIVERSE])
def existence_check(spark, sf_dir):
    return un.missing_entities(texts(spark, sf_dir), some_universe(spark, sf_dir))


@query("lag_pair_join", "entity:i lag:i n:i cross_sum:f",
       """SELECT a.entity, a.t - b.t AS lag, count(*) AS n, sum(a.x * b.x) AS cross_sum FROM s a JOIN s b
  ON a.entity = b.entity AND a.t - b.t BETWEEN 1 AND 5 GROUP BY 1, 2""",
       [BARS, "s AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY date) - 1 AS t, volume AS x FROM bars)"])
def lag_pair_join(spark, sf_dir):
    b = bars(spark, sf_dir)
    rows = b.join(panel_rows(b, ["entity"]), ["entity", "date"])
    pairs = lag_pairs(rows, ["entity"], "row_idx", "volume", 5)
    return pairs.groupBy("entity", "lag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("x_lag")).alias("cross_sum"))


@query("union_parts", "part:s entity:i date:d close:f",
       "SELECT 'early' AS part, entity, date, close FROM bars WHERE date < DATE '1998-01-01' UNION ALL SELECT 'late', entity, date, close FROM bars WHERE date >= DATE '1998-01-01'",
       [BARS])
def union_parts(spark, sf_dir):
    b = bars(spark, sf_dir).select("entity", "date", "close")
    cut = F.lit(Date(1998, 1, 1))
    return rp.union_parts(b.where(F.col("date") < cut).withColumn("part", F.lit("early")),
                          b.where(F.col("date") >= cut).withColumn("part", F.lit("late")))


@query("intersect_keys", "entity:i date:d",
       "SELECT entity, date FROM bars INTERSECT SELECT l_partkey % 1000, CAST(date_trunc('week', l_shipdate) AS DATE) FROM lineitem", [BARS])
def intersect_keys(spark, sf_dir):
    other = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 1000).alias("entity"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))
    return rp.intersect_keys(bars(spark, sf_dir), other, ["entity", "date"])


@query("case_mismatch", "s_name:s", "SELECT s_name FROM supplier WHERE s_name <> upper(s_name)")
def case_mismatch(spark, sf_dir):
    return un.case_mismatch(table(spark, sf_dir, "supplier"), "s_name")


# ---- scalar families ---------------------------------------------------------------------

@query("string_functions", "s_suppkey:i trimmed:s cut:s is_supplier:b number:s swapped:s last_part:s",
       """SELECT s_suppkey, trim('  ' || s_name || ' ') AS trimmed, substring(s_name, 1, 12) AS cut, starts_with(s_name, 'Supplier#') AS is_supplier,
  regexp_extract(s_name, '^Supplier#(\\d+)$', 1) AS number, replace(s_name, '#', '_') AS swapped, string_split(s_name, '#')[-1] AS last_part FROM supplier""")
def string_functions(spark, sf_dir):
    n = F.col("s_name")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"), F.substring(n, 1, 12).alias("cut"),
        F.startswith(n, F.lit("Supplier#")).alias("is_supplier"), F.regexp_extract(n, r"^Supplier#(\d+)$", 1).alias("number"),
        F.replace(n, F.lit("#"), F.lit("_")).alias("swapped"), F.element_at(F.split(n, "#"), -1).alias("last_part"))


@query("date_functions", "event_id:i parsed:d bad_is_null:b year:i days_in:i month_text:s",
       """SELECT event_id, CAST(ts AS DATE) AS parsed, true AS bad_is_null, year(ts) AS year, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days_in,
  strftime(ts, '%Y-%m') AS month_text FROM events""")
def date_functions(spark, sf_dir):
    from barweave.sources.readers import to_utc
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    return table(spark, sf_dir, "events").select(
        "event_id", utc_day(to_utc(text)).alias("parsed"), to_utc(F.concat(F.lit("x"), "event_type")).isNull().alias("bad_is_null"),
        F.year("ts").alias("year"), F.date_diff(F.to_date("ts"), F.lit(Date(2024, 1, 1))).alias("days_in"),
        F.date_format("ts", "yyyy-MM").alias("month_text"))


@query("math_functions", "event_id:i a:f b:f c:f d:f e:f f:f g:f h:f",
       """SELECT event_id, ln(value) AS a, ln(1 + value) AS b, log10(value) AS c, exp(-value / 100) AS d, exp(value / 1000) - 1 AS e, sqrt(value) AS f,
  1 / (1 + exp(-(value - 50) / 10)) AS g, greatest(10.0, least(60.0, value)) AS h FROM events""")
def math_functions(spark, sf_dir):
    from barweave.functions.maths import bounded, sigmoid
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.ln(v).alias("a"), F.log1p(v).alias("b"), F.log10(v).alias("c"), F.exp(-v / 100).alias("d"),
        F.expm1(v / 1000).alias("e"), F.sqrt(v).alias("f"), sigmoid((v - 50) / 10).alias("g"), bounded(v, 10.0, 60.0).alias("h"))


@query("json_array_map", "event_id:i k:i doubled:i n_keys:i",
       """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 2 * CAST(json_extract(props, '$.k') AS BIGINT) AS doubled, 1 AS n_keys FROM events""")
def json_array_map(spark, sf_dir):
    parsed = F.from_json("props", "map<string, bigint>")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("m")).select(
        "event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.size("m").alias("n_keys"), F.explode(F.map_entries("m")).alias("x")).select(
        "event_id", "k", "n_keys", (F.col("x.value") * 2).alias("doubled"))
