"""Benchmark the headline queries.

Runs each query on the parquet tables of $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and forces full execution with the no-op sink (no collect to the driver).
Prints one JSON line: {"metric", "value" (sum of seconds), "unit", "queries": {...}, "warm": {...}, "sf"}.
"queries" are cold: each has a mart store of its own, so its whole lineage is built from the raw tables. "warm"
is the same query again over the marts that the cold run has left.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "kpi_daily",
    "kpi_monthly",
    "kpi_breakdown",
    "monitor_targets",
    "robust_score_core",
    "detect_run",
    "stream_kpi_daily",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from kpiforge.martstore import DIR
    from kpiforge.session import local_session
    from kpiforge.plans.catalog import all_queries

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="kpiforge-bench")
    queries = all_queries()
    names = [n for n in HEADLINE if n in queries]
    spark.conf.set(DIR, tempfile.mkdtemp(prefix="bench-"))
    # JVM / code-generation warm-up on the smallest tables (not timed).
    warm_dir = "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir
    queries["fct_orders"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    warm: dict[str, float] = {}
    shared = tempfile.mkdtemp(prefix="bench-")
    for name in names:
        spark.conf.set(DIR, f"{shared}/{name}")
        for found in (timings, warm):
            t0 = time.perf_counter()
            df = queries[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            found[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "warm": warm,
                "sf": float(m.group(1)) if m else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
