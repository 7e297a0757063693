"""Bench the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_WARM_DIR (default /root/testdata/sf0.001).
Each query runs its full plan into Spark's ``noop`` sink (nothing is
collected to the driver); the time includes any job a query starts itself
(hot-key detection, small materialised outputs).

Before timing, every headline query runs once on the small warm-up tables
(a different directory, so no measured file is read early): the JVM then
has compiled the code paths the timed runs use, as on a long-running
cluster. The timed runs read the benchmark tables cold from Spark's side
(nothing is cached).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigil.plans.catalog import REGISTRY  # noqa: E402
from vigil.session import local_session  # noqa: E402

HEADLINE = [
    "classify",
    "blocklist",
    "queue_now",
    "actions",
    "not_found",
    "comment_status",
    "latest_feedback",
    "merged_training",
    "flag_precision",
    "threshold_sweep",
    "lexicon_hits",
    "page_elements",
    "scan_pages",
    "train_log",
    "load_unique",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="vigil-bench")
    # Warm-up on separate small tables: JIT and Python workers, not timed.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir) or os.path.realpath(warm_dir) == os.path.realpath(sf_dir):
        warm_dir = None
    for name in HEADLINE if warm_dir else ["classify"]:
        REGISTRY[name](spark, warm_dir or sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
