"""Time the headline queries; prints one JSON line.

The derived logs are written before the clock starts: they are the input.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks import queries as checked  # noqa: E402
from checks.derived import log_dir, log_lines  # noqa: E402
from logweft.operators.packing import CHUNK_ROWS  # noqa: E402

HEADLINE = [
    "level_counts",
    "extract_fields",
    "iter_entries",
    "filter_keyword",
    "dedup_groups",
    "collect_line_numbers",
    "dashboard",
    "top5_summary",
    "sort_time",
    "score_patterns",
    "report_csv",
    "split_by_size",
    "run_analysis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logweft-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    log_lines(spark, sf_dir)
    log_dir(spark, sf_dir)
    # The checks pack in tiny chunks so that chunks are composed; a run has the usual ones.
    checked.CHUNK_ROWS = CHUNK_ROWS
    seconds = {}
    for name in names:
        started = time.perf_counter()
        checked.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
