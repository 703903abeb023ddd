"""Times headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
The first entry builds the portfolio tables, ledger included; the others read them. Every
query is executed completely into a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loanweave.plans import catalog  # noqa: E402
from loanweave.plans.star import TABLES, StarPortfolio  # noqa: E402
from loanweave.session import local_session  # noqa: E402

HEADLINE = (
    "mart_delinquency_monthly",
    "mart_portfolio_monthly",
    "mart_credit_funnel_monthly",
    "mart_vintage_cohorts",
    "mart_roll_rates",
    "mart_cure_and_redefault",
    "mart_collections_performance",
    "mart_writeoff_recovery",
    "mart_scenario_comparison",
    "mart_macro_stress_pre_post",
    "credit_risk_segment_summary",
    "composition_vs_performance",
    "run_metrics",
    "reconciliation",
    "contract_findings",
    "ledger_expectation",
    "payment_waterfall",
    "amortization_schedule",
    "batch_quality",
    "feature_drift",
    "discrimination_by_language",
    "behavioural_features",
    "incidents",
)


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus), memory="16g")
    catalog.load()
    portfolio = StarPortfolio(spark, sf_dir)
    queries = {"portfolio_build": timed(lambda: [portfolio[t].schema for t in TABLES])}
    for name in wanted:
        fn = catalog.spark_query(name)
        queries[name] = timed(lambda fn=fn: run(fn(spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
