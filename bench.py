"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The events are first stored in several files, as a lake has them, so that scans run in parallel. Each query runs once to
warm up and then $BENCH_RUNS times (3); its figure is the median. The validator is timed from stored stream records.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from plantwatch.checks.queries import QUERIES
from plantwatch.operators import aggregates, diagnose, validate
from plantwatch.session import local_session, work_dir
from plantwatch.sources import fixture, lake

HEADLINE = [
    "count_by_type", "avg_temp_by_machine", "anomaly_trend", "most_active", "avg_temp_by_type", "anomaly_rate",
    "daily_volume", "energy_by_type", "machine_health_view", "anomaly_summary_view", "daily_summary_view",
    "hourly_summary_view", "timeseries_view", "sum_full", "machines", "business_kpis", "activity_kpis_24h", "diagnose",
    "root_cause_distribution", "latest_per_machine", "machine_history_24h", "anomaly_episodes", "status_transitions",
    "rolling_features", "correlated_failures", "recommendations", "hourly_trends",
]


def prepared(spark, sf_dir, files):
    """The events in several files, stored stream records, and the curated table."""
    base = work_dir(spark, "bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(files).write.parquet(f"{base}/events.parquet")
    rows = fixture.telemetry(spark, base)
    fixture.stream_records(rows).write.parquet(f"{base}/records")
    lake.write_curated(diagnose.diagnose(rows), f"{base}/curated")
    return base


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, app="bench")
    base = prepared(spark, sf_dir, int(cpus))
    jobs = {name: (lambda f=QUERIES[name]: f(spark, base)) for name in HEADLINE}
    pruned = lambda: aggregates.temperature_sum(lake.curated_table(spark, f"{base}/curated"), "assembly_robot", 2024, 1, 15)
    jobs["sum_pruned"] = pruned
    jobs["validate_route"] = lambda: validate.validate_route(spark.read.parquet(f"{base}/records"))
    seconds = {}
    for name, job in jobs.items():
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 3)
        print(name, [round(t, 2) for t in took], file=sys.stderr)
    scan = lake.curated_table(spark, f"{base}/curated")
    folders = lambda df: df.select(F.input_file_name().alias("f")).select(F.regexp_extract("f", "(.*)/[^/]*$", 1)).distinct().count()
    one = scan.filter("machine_type = 'assembly_robot' AND year = 2024 AND month = 1 AND day = 15")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
                      "partitions": {"all": folders(scan), "sum_pruned": folders(one)}}))
    spark.stop()


if __name__ == "__main__":
    main()
