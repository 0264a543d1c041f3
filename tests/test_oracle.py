"""Registered queries against their SQL on the smallest tables (all of them with BARWEAVE_ALL=1)."""

import os

import pytest

from barweave.plans.catalog import QUERIES
from oracle_check import compare, connect

QUICK = """scan_news scan_prices write_partitioned upsert_results panel_csv_unpivot scaled_cache select_text score_articles
calendar_features alpha_features decay_impute vol_zscore series_decompose ema_bias_corrected point_adjust dominant_periods
curate_universe seeded_subset audit_block audit_daily check_calendar purged_split entity_eligibility patches
risk_aware_weights portfolio_returns_legacy metric_block argmax_topn rank_ic_spearman rank_ic_kendall ic_summary sharpe_ci
studentized_diff holm deflated_sharpe load_cell_summaries margin_bce daily_sentiment_stream""".split()
NAMES = list(QUERIES) if os.environ.get("BARWEAVE_ALL") else QUICK


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf_dir, name):
    verdict, _ = compare(con, spark, QUERIES[name], sf_dir)
    assert verdict == "ok"


def test_every_query_has_sql():
    assert all(q.sql for q in QUERIES.values())


def test_turnover_since_the_previous_rebalance(spark, con, sf_dir):
    verdict, n = compare(con, spark, QUERIES["portfolio_returns_rebalanced"], sf_dir)
    assert verdict == "ok" and n > 0
    daily, other = (con.execute(QUERIES[q].sql).df().query("horizon > 1").turnover.sum() for q in ("portfolio_returns", "portfolio_returns_rebalanced"))
    assert daily != pytest.approx(other)
