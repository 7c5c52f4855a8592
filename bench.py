"""Headline timings: one JSON line with the median of the warm runs (BENCH_RUNS, default 2) per query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from loglathe import session
from loglathe.plans import registry

HEADLINE = [
    "parse_network",
    "parse_container",
    "parse_database",
    "parse_web",
    "parse_cloud",
    "parse_security",
    "parse_syslog",
    "parse_integration",
    "parse_iot",
    "parse_custom",
    "transform_logs_v2",
    "transform_logs_v1",
    "intake_envelope",
    "batch_template_v2",
    "rate_limit",
    "rate_limit_running",
    "admission_status",
    "process_logs_indexed",
    "hot_table",
    "keyed_publish",
    "stream_sink",
    "log_search",
    "error_frequency",
    "ingestion_rate",
    "level_rollup",
    "latency_histogram",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    workers = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(workers))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in session.STATIC_SETTINGS.items():
        spark = spark.config(key, value)
    spark = spark.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    session.configure(spark)
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for attempt in range(runs + 1):
            started = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:  # the first run is the warm-up
                taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "log_queries_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
