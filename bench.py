"""Times the headline queries on one local session and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablegauge.queries import all_queries  # noqa: E402
from tablegauge.session import STATIC_SETTINGS  # noqa: E402

HEADLINE = (
    "overview",
    "numeric_summary",
    "histograms",
    "pearson",
    "spearman",
    "run_column_metrics",
    "bar_charts",
    "duplicate_totals",
    "iqr_outliers",
    "completeness_dataset_issue",
    "uniqueness_score",
    "conformance_issues",
    "rule_issues",
    "balance_index",
    "freshness",
    "diversity_score",
    "quality_scores",
    "gate_verdicts",
    "diff_summary",
    "version_issue_compare",
    "root_datasets",
    "project_snapshots",
    "evaluated_run",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablegauge-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config(map=STATIC_SETTINGS)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tablegauge-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
