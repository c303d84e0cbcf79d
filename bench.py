"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8) and ``BENCH_QUERIES``
(comma separated names, or ``all``) choose what runs. Each query is built and its
result written to Spark's noop sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from driftlane.plans.catalogue import QUERIES
from driftlane.session import build_session

HEADLINE = (
    "drift_report_raw_baseline", "drift_report_stored_deciles", "drift_alerts", "baseline_numeric_profile",
    "accuracy_report", "accuracy_sliding_windows", "label_coverage", "label_latency", "kpi_cards", "hourly_volume",
    "psi_pivot_filled", "alert_evidence", "alert_diagnosis", "alert_assignment", "incident_pass",
    "quarantined_churn_requests", "stratified_split", "ordered_holdout_split", "metric_gate", "canary_decisions",
    "scenario_response_curve", "welch_statistics", "chi_square_statistics", "train_and_evaluate",
    "stream_hourly_volume", "stream_alert_dedup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
            "spark.sql.files.maxPartitionBytes": "4m", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
