"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; one JSON line on stdout.

Each query runs once to warm up and then $BENCH_RUNS times (3); its figure is the median. Every run
builds its plan anew and writes the whole result to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload.queries import REGISTERED  # noqa: E402

HEADLINE = [
    "split_by_time",
    "duplicate_rows",
    "quality_table",
    "ks_statistic",
    "drift_table",
    "binary_metrics",
    "roc_auc",
    "roc_curve",
    "ranked_metrics_fine",
    "performance_table",
    "regression_metrics",
    "calibration_curve",
    "segments_binary",
    "threshold_sweep",
    "full_analysis_binary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
