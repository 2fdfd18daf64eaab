"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the cores. Each query runs once to
warm up and then twice; the mean of the two counts. Results go to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace.plans.queries import REGISTRY  # noqa: E402
from millrace.session import SESSION_OPTIONS  # noqa: E402

HEADLINES = (
    "latest_task_values", "latest_by_rank", "latest_value_freshness", "readable_samples",
    "tag_trend_all", "quality_segments", "dashboard_by_user", "import_counters",
    "import_from_files", "retention_preview", "integrity_audit", "bm25_top5", "hybrid_top5",
    "stream_dedup_counters",
)
RUNS = 2


def session(cpus: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    options = {
        **SESSION_OPTIONS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.driver.memory": "16g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_once(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in HEADLINES:
        run_once(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(RUNS)), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "import_rows_per_second": round(events / seconds["import_counters"]),
                "file_import_rows_per_second": round(events / seconds["import_from_files"]),
            }
        )
    )


if __name__ == "__main__":
    main()
