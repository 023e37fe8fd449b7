"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.

Every query is fully evaluated through the ``noop`` sink (all rows computed,
nothing collected to the driver).  One warm-up pass is discarded; each query
then reports the median of ``$BENCH_REPEAT`` runs (default 3).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetcat.plans.registry import QUERIES, load_all  # noqa: E402
from fleetcat.session import build_session  # noqa: E402

HEADLINE = [
    "A9_lineage_summary",      # lineage: regex extraction + resolve joins
    "J1_measure_usage",        # usage: field cleaning + equi-join
    "J2_unused_report",        # substring containment as exact equi-join
    "A3_threshold_observations",
    "J7_overlap_pairs",        # spatial grid join
    "W1_W2_wireframe",         # iterative greedy absorption (J8) + skew-safe numbering
    "T5_measures",             # definition-text segmentation (windows)
    "T7_calculation_items",
    "S1_scan_definition_lines",
    "S3_scan_layout_json",
    "S4_scan_page_files",
    "P7_redact_sensitive",     # whole documents
    "P26_audit_embedded_blocks",
    "A10_definition_export",
    "M13_all_share",
    "M25_userelationship",
    "M27_totalytd",
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    load_all()
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="fleetcat-bench")
    names = only or HEADLINE
    for n in names:  # warm-up pass (JIT, caches), discarded
        run(spark, n, sf_dir)
    times = {}
    for n in names:
        times[n] = round(statistics.median(run(spark, n, sf_dir) for _ in range(repeat)), 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
