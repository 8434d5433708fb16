"""Time the headline queries on the tables of $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from reasonloom.plans.queries import QUERIES
from reasonloom.session import remove_scratch

HEADLINE = (
    "curate",
    "filter_funnel",
    "write_filtered",
    "render_prompt",
    "token_spans",
    "examples",
    "example_arrays",
    "vocab",
    "encode_ids",
    "shuffle_rows",
    "collate",
    "base_loss",
    "efficiency",
    "repetition",
    "combined",
    "render_chat",
    "token_ce",
    "sample_files_ratio",
    "file_offsets",
)
REPETITIONS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("reasonloom-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # JVM start is not measured
    seconds = {}
    for name in names:
        runs = []
        for _ in range(REPETITIONS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            remove_scratch(spark)
        seconds[name] = round(min(runs), 3)
    result = {
        "metric": "total seconds of the headline queries, best of 2 runs each",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
