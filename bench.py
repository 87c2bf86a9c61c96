"""Time the headline queries and print one JSON line.

Every query runs to the end with its result thrown away (noop sink), so the figures cover scanning,
shuffling and computing, not the transfer of rows to the driver.
"""

from __future__ import annotations

import json
import os
import time

from barloom.plans import catalogue
from barloom.session import build_session

HEADLINE = [
    "flagship_backtest", "factor_table", "backtest_metrics", "compare_strategies", "evaluate_factor", "neutralize_both", "composite_signal",
    "cs_rank", "cs_demedian", "filter_by_ic", "agg_corr_matrix", "daily_ic", "technical_bundle", "market_beta", "holding_period_returns",
    "risk_events", "factor_exposure", "var_historical", "stress_test", "incremental_merge", "forward_returns_calendar", "walk_forward_folds",
    "cv_objective", "market_snapshot", "fn_median", "fn_rank", "ind_sar", "deps_closure", "knn_topk", "write_panel",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue()
    # one untimed run starts the JVM's code generation and the Python workers
    queries["ind_ema"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
