"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run once to warm up and then three times; the median wall time
of building its plan plus a full execution (``noop`` sink: every row is
produced, nothing is collected) is reported.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans.registry import all_entries  # noqa: E402
from quarry.plans.views import view  # noqa: E402
from quarry.session import get_spark  # noqa: E402
from quarry.sources.tables import load  # noqa: E402

HEADLINE = ["ml_topn", "extract_sql", "quota_sample", "results_match_bag", "execute_examples",
            "e2e_multijoin_count", "select_candidate", "seeded_shuffle"]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def run_once(build) -> float:
    """Wall time of building the plan (some builders run eager checkpoint
    jobs) and executing it in full."""
    t0 = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    ents = all_entries()
    # input sizes, for rows per second
    rows_in = {
        "extract_sql": view(spark, sf_dir, "predictions").count(),
        "quota_sample": view(spark, sf_dir, "examples").count(),
        "results_match_bag": view(spark, sf_dir, "result_rows").count(),
        "ml_topn": load(spark, sf_dir, "lineitem").count(),
    }
    rows_in["execute_examples"] = rows_in["quota_sample"] + rows_in["extract_sql"]
    times, per_sec = {}, {}
    for k in HEADLINE:
        def build(k=k):
            return ents[k].build(spark, sf_dir)
        run_once(build)  # warm-up
        ts = [run_once(build) for _ in range(RUNS)]
        times[k] = round(statistics.median(ts), 3)
        if k in rows_in:
            per_sec[k] = round(rows_in[k] / times[k], 1)
    out = {
        "metric": "headline_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows_per_sec": per_sec,
        "input_rows": rows_in,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": int(cpus),
        "runs": RUNS,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
