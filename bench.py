"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from cardwatch.catalog import QUERIES
from cardwatch.session import build_session, clear_scratch

HEADLINE = [
    "merchant_daily_metrics",
    "merchant_hourly_fraud",
    "fast_pass_performance",
    "merchant_attributions",
    "operational_sla",
    "blocked_transactions",
    "fast_pass_score",
    "pareto_merchants",
    "day_over_day",
    "confusion_matrix",
    "roc_auc",
    "latency_summary",
    "insert_if_absent",
    "online_enrichment",
    "point_in_time_enrichment",
    "velocity_features",
    "neighbour_mean",
    "rebalanced",
    "stratified_folds",
    "mined_thresholds",
    "wasserstein_drift",
    "drift_verdict",
    "alert_outbox",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["row_count"](spark, sf_dir).collect()  # start executors and load classes before timing
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    clear_scratch(spark)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
