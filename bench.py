"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("mask_logs", "severity_of_logs", "component_of_logs", "drain_templates", "rate_z", "anomaly_reasons", "alert_cooldown", "template_rollup", "hash_embedding_sparse", "pipeline_lines")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "1m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from logtide.queries import QUERIES

    logs = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    took = {}
    for name in HEADLINE:
        times = []
        for turn in range(4):  # one warm-up, then the median of three
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if turn:
                times.append(time.time() - began)
            elif time.time() - began > 60:
                times = [time.time() - began]
                break
        took[name] = round(sorted(times)[len(times) // 2], 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "logs": logs, "logs_per_second": {k: round(logs / v) for k, v in took.items()}}))


if __name__ == "__main__":
    main()
