"""Benchmark: seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tallyfolio.plans import catalog
from tallyfolio.session import local_session

HEADLINE = [
    "daily_portfolio_value", "ledger_eur_changes", "account_categories", "quarterly_costs", "trailing_performance",
    "performance_dashboard", "period_rates", "drawdown_summary", "holdings_catalog", "holdings_report",
    "category_allocation", "reconciliation", "position_attribution", "open_cost_basis", "daily_cost_basis",
    "correlated_pairs", "normalized_median", "smoothed_median", "continuation_repair", "normalized_ledger", "exchange_matches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
