"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from veilframe.plans import catalog

HEADLINE = ("detect_and_redact", "pipeline_full", "normalize_text", "sweep_text", "gt_occurrences", "transcript_metrics", "overall_metrics", "missed_categories", "sequence_id")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):  # the first run compiles
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    chars = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").first()[0]
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "detect_chars_per_sec": round(chars / took["detect_and_redact"]), "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
