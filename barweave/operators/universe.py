"""News coverage, price diagnostics and universe selection."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date as Date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.maths import as_col
from barweave.functions.text import norm_symbol
from barweave.operators.ordering import exact_quantiles


@dataclass(frozen=True)
class CurationConfig:
    """Thresholds of the selection; the defaults are the published ones."""

    news_years: tuple[int, int] = (2017, 2018)
    news_min: tuple[int, int] = (30, 30)
    price_start: Date = Date(2009, 1, 15)
    price_end: Date = Date(2023, 12, 15)
    end_slack_days: int = 14
    min_rows: int = 100
    min_window_rows: int = 1000
    liquidity_year: int = 2018
    min_liquidity_rows: int = 100
    max_gap_days: int = 7
    min_dollar_volume: float = 5e6
    target: int = 300
    coverage_years: list[int] = field(default_factory=lambda: list(range(2009, 2024)))


def news_counts(news: DataFrame, entity: str = "entity", ts: str = "ts") -> DataFrame:
    return news.groupBy(entity, F.year(as_col(ts)).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def year_sum(year: Column, n, test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, as_col(n))), F.lit(0))


def news_coverage(counts: DataFrame, years: list[int], entity: str = "entity") -> DataFrame:
    """One row per entity: total plus one zero-filled column per year; rows outside ``years`` count in the total."""
    cols = [year_sum(F.col("year"), "n", F.col("year") == y).alias(f"n_{y}") for y in years]
    return counts.groupBy(entity).agg(F.sum("n").alias("n_total"), *cols)


def coverage_buckets(universe: DataFrame, counts: DataFrame, first: int, years: list[int],
                     entity: str = "entity") -> DataFrame:
    """Counts before ``first`` and per later year; entities without news keep zeros."""
    y = F.col("year")
    aggs = [year_sum(y, "n", y < first).alias(f"n_pre{first}")]
    aggs += [year_sum(y, "n", y == k).alias(f"n_{k}") for k in years]
    joined = universe.select(entity).join(counts, entity, "left")
    return joined.groupBy(entity).agg(*aggs, F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"))


def coverage_stats(coverage: DataFrame, cols: list[str]) -> DataFrame:
    """Median, P10 and P90 of each count column, exact at any number of entities."""
    long = coverage.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_s")).select("_s.*")
    return exact_quantiles(long, ["metric"], "v", {"median": 0.5, "p10": 0.1, "p90": 0.9})


def fold_shortfalls(coverage: DataFrame, folds: list, min_n: int = 20) -> DataFrame:
    """Per fold: entities below ``min_n`` in its validation and its test year."""
    rows = F.array(*[
        F.struct(F.lit(f.name).alias("fold"), (F.col(f"n_{f.val_year}") < min_n).alias("v"),
                 (F.col(f"n_{f.test_year}") < min_n).alias("t")) for f in folds])
    return coverage.select(F.explode(rows).alias("_r")).groupBy(F.col("_r.fold").alias("fold")).agg(
        F.count_if("_r.v").alias("bad_val"), F.count_if("_r.t").alias("bad_test"))


def median_dollar_volume(bars: DataFrame, year: int, min_rows: int = 100, entity: str = "entity",
                         date: str = "date") -> DataFrame:
    """Exact median of close x volume in one year (at most one row per day and entity)."""
    inside = bars.where(F.year(date) == year)
    return inside.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"), F.median(F.col("close") * F.col("volume")).alias("median_dollar_vol"),
    ).where(F.col("n_rows") >= min_rows)


def max_gap_days(bars: DataFrame, entity: str = "entity", date: str = "date") -> DataFrame:
    w = Window.partitionBy(entity).orderBy(date)
    gap = F.date_diff(F.col(date), F.lag(date).over(w))
    return bars.select(entity, gap.alias("_g")).groupBy(entity).agg(
        F.coalesce(F.max("_g"), F.lit(99)).alias("max_gap_days"))


def price_diagnostics(bars: DataFrame, cfg: CurationConfig = CurationConfig(), entity: str = "entity",
                      date: str = "date") -> DataFrame:
    """First failing reason per entity (NULL when it passes) and the figures behind it."""
    w = Window.partitionBy(entity).orderBy(date)
    d = F.col(date)
    inside = d.between(F.lit(cfg.price_start), F.lit(cfg.price_end))
    liquid = inside & (F.year(d) == cfg.liquidity_year)
    gap = F.date_diff(d, F.lag(F.when(inside, d)).over(w))
    close, dollars = F.col("close"), F.col("close") * F.col("volume")
    per = bars.withColumn("_gap", F.when(inside, gap)).groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(d).alias("price_start"), F.max(d).alias("price_end"),
        F.count_if(inside).alias("n_price_rows"), F.coalesce(F.max("_gap"), F.lit(99)).alias("max_gap_days"),
        F.count_if(liquid).alias("_nl"), F.median(F.when(liquid, dollars)).alias("median_dollar_vol"),
        F.stddev_samp(F.when(liquid, close)).alias("_sd"), F.avg(F.when(liquid, close)).alias("close_liquidity_mean"),
    )
    reason = (
        F.when(F.col("n_rows") < cfg.min_rows, "too_short")
        .when(F.col("price_start") > F.lit(cfg.price_start), "starts_too_late")
        .when(F.col("price_end") < F.date_sub(F.lit(cfg.price_end), cfg.end_slack_days), "ends_too_early")
        .when(F.col("n_price_rows") < cfg.min_window_rows, "in_window_too_short")
        .when(F.col("_nl") < cfg.min_liquidity_rows, f"no_{cfg.liquidity_year}_data")
        .when(F.col("_sd") < 1e-3 * F.col("close_liquidity_mean"), "constant_liquidity_close")
    )
    return per.withColumn("error", reason).drop("_nl", "_sd")


def semi_join_universe(df: DataFrame, universe: DataFrame, entity: str = "entity") -> DataFrame:
    """Keep rows of known entities; the join strategy follows the measured size of the universe."""
    return df.join(universe.select(entity), entity, "left_semi")


def prefilter(news: DataFrame, universe: DataFrame, max_chars: int | None = None, entity: str = "entity",
              body: str = "body") -> DataFrame:
    """Articles of the universe with upper-cased symbol; ``max_chars`` cuts bodies only when asked."""
    upper = news.withColumn(entity, norm_symbol(F.col(entity).cast("string"), trimmed=False))
    known = universe.select(norm_symbol(F.col(entity).cast("string"), trimmed=False).alias(entity)).distinct()
    kept = upper.join(known, entity, "left_semi")
    return kept if max_chars is None else kept.withColumn(body, F.substring(body, 1, max_chars))


def missing_entities(universe: DataFrame, present: DataFrame, entity: str = "entity") -> DataFrame:
    return universe.select(entity).distinct().join(present.select(entity), entity, "left_anti")


def case_mismatch(universe: DataFrame, entity: str = "entity") -> DataFrame:
    return universe.where(F.col(entity) != F.upper(entity))


def tier(df: DataFrame, col: str = "selection_news") -> DataFrame:
    """STRONG at or above the upper quartile, MEDIUM at or above the lower one, else WEAK."""
    cuts = exact_quantiles(df, [], col, {"q25": 0.25, "q75": 0.75})
    both = df.withColumn("_q", cuts.select(F.struct("q25", "q75")).scalar())
    label = F.when(F.col(col) >= F.col("_q.q75"), "STRONG").when(F.col(col) >= F.col("_q.q25"), "MEDIUM").otherwise("WEAK")
    return both.withColumn("tier", label).drop("_q")


def composite_score(a, b, dollars) -> Column:
    return F.log1p(as_col(b)) + 0.5 * F.log1p(as_col(a)) + 0.2 * F.log10(F.greatest(as_col(dollars), F.lit(1.0)))


def composite_topn(df: DataFrame, a: str, b: str, n: int = 300, dollars: str = "median_dollar_vol",
                   entity: str = "entity") -> DataFrame:
    """Best ``n`` by composite score; planned as a distributed top-k."""
    scored = df.withColumn("composite_score", composite_score(a, b, dollars))
    return scored.orderBy(F.desc("composite_score"), entity).limit(n)


def hash_order(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def seeded_subset(df: DataFrame, n: int = 50, seed: int = 2026, entity: str = "entity") -> DataFrame:
    """``n`` STRONG entities by seeded hash order; a short pool is padded with the next best scores."""
    strong = F.col("tier") == "STRONG"
    picked = df.withColumn("_g", F.when(strong, 0).otherwise(1)) \
        .withColumn("_h", F.when(strong, hash_order(seed, entity))) \
        .withColumn("_s", F.when(~strong, F.col("composite_score")))
    order = ["_g", "_h", F.desc("_s"), entity]
    return picked.orderBy(*order).limit(n).drop("_g", "_h", "_s")


def article_sample(news: DataFrame, n: int = 50, seed: int = 2026, key: str = "article_id") -> DataFrame:
    """``n`` articles in seeded hash order."""
    return news.orderBy(hash_order(seed, key), key).limit(n)


def entity_sample(news: DataFrame, n_entities: int, per_entity: int, seed: int = 2026, entity: str = "entity",
                  order: list[str] | None = None) -> DataFrame:
    """First ``per_entity`` articles of ``n_entities`` entities drawn in seeded hash order."""
    drawn = news.select(entity).distinct().orderBy(hash_order(seed, entity), entity).limit(n_entities)
    w = Window.partitionBy(entity).orderBy(*(order or ["ts", "article_id"]))
    return news.join(drawn, entity, "left_semi").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_entity)


def news_passing(counts: DataFrame, cfg: CurationConfig, entity: str = "entity") -> DataFrame:
    a, b = cfg.news_years
    y = F.col("year")
    both = counts.where(y.isin(a, b)).groupBy(entity).agg(
        year_sum(y, "n", y == a).alias("n_a"), year_sum(y, "n", y == b).alias("n_b"))
    return both.where((F.col("n_a") >= cfg.news_min[0]) & (F.col("n_b") >= cfg.news_min[1]))


def price_passing(bars: DataFrame, cfg: CurationConfig, entity: str = "entity") -> DataFrame:
    return price_diagnostics(bars, cfg, entity).where(
        F.col("error").isNull() & (F.col("max_gap_days") <= cfg.max_gap_days)
        & (F.col("median_dollar_vol") >= cfg.min_dollar_volume))


def curate_universe(news: DataFrame, bars: DataFrame, cfg: CurationConfig = CurationConfig(),
                    entity: str = "entity") -> DataFrame:
    """News and price filters, inner join, tiers, composite score, best ``cfg.target`` entities."""
    passed = news_passing(news_counts(news, entity), cfg, entity)
    merged = passed.join(price_passing(bars, cfg, entity), entity, "inner")
    ranked = tier(merged.withColumn("selection_news", F.col("n_a") + F.col("n_b")))
    return composite_topn(ranked, "n_a", "n_b", cfg.target, entity=entity)
