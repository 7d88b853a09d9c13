"""Headline queries on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from maskwright.plans.catalog import QUERIES

HEADLINE = (
    "mask_documents", "mask_source_sessions", "restore_documents", "vault_assign", "detect_registry",
    "evaluate_characters", "activity_summary", "merge_overlaps", "resolve_spans", "ledger_replay",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="maskwright-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline query seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rsplit("sf", 1)[-1].strip("/"),
    }))


if __name__ == "__main__":
    main()
