"""Times the headline queries and prints one JSON line.

Every query runs in full (noop sink), once to warm the JVM and ``BENCH_RUNS``
times on the clock; the best run counts.  ``files_per_sec`` is the number of
documents over the time of a scan, the unit the reference numbers are given in.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from keysift.plans.queries import QUERIES  # noqa: E402
from keysift.plans.tables import table  # noqa: E402

HEADLINE = (
    "line_index", "match_by_pattern", "scored_findings", "planted_scores", "risk_summary",
    "pattern_summary", "pem_whole_file", "redacted_text", "dedup_findings", "secret_reuse",
    "incremental_hash_set", "remediated_findings", "blame_attribution", "sorted_findings",
    "snapshot_diff", "tree_digest", "csv_report", "json_report", "sarif_report",
    "event_log_levels", "file_tree_scan", "blame_ranges", "stream_new_secrets",
    "all_reports",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("keysift-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="keysift-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(cpus)
    run(spark, sf_dir, "planted_scores")
    times = {name: min(run(spark, sf_dir, name) for _ in range(runs)) for name in HEADLINE}
    n_files = table(spark, sf_dir, "documents").count()
    spark.stop()
    print(json.dumps({
        "metric": "keysift headline queries, total seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(seconds, 3) for name, seconds in times.items()},
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "files": n_files,
        "files_per_sec": {
            name: round(n_files / times[name])
            for name in ("scored_findings", "planted_scores", "json_report", "file_tree_scan")
        },
    }))


if __name__ == "__main__":
    main()
