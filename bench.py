"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1).
Each query runs once to warm up, then BENCH_RUNS times; the best time counts.
"""

from __future__ import annotations

import json
import os
import time

from barweave.plans.catalog import QUERIES
from barweave.session import local_session

HEADLINE = [
    "daily_sentiment", "decay_impute", "score_articles", "curate_universe", "audit_block", "alpha_features", "purged_split",
    "collect_signals", "cross_section_rank", "portfolio_returns", "metric_block", "cost_sweep", "rank_ic_spearman",
    "sharpe_ci", "deflated_sharpe", "daily_sentiment_stream", "vol_kill_switch", "pointwise_sharpe_median", "timeseries_export", "margin_bce",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "barweave-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if attempt == 1 else min(best, took) if attempt else best
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
