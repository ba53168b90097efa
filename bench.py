"""Headline-query benchmark.

Runs the registered queries listed in HEADLINE on ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one
JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.

Every query is evaluated in full (a ``noop`` write runs the whole plan, no
collect to the driver). Each query starts from a clean cache; a trivial
warm-up job runs first so JVM start-up is not charged to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailroom.plans import catalog  # noqa: E402
from mailroom.session import build_session  # noqa: E402
from mailroom.sources.fixtures import Fixtures  # noqa: E402

HEADLINE = [
    "dashboard_stats",
    "list_page",
    "recent_activity",
    "kb_chunk",
    "kb_index",
    "kb_topk",
    "benchmark_topk",
    "parse_responses",
    "message_dedup",
    "apply_decisions",
    "triage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="mailroom-bench")
    # JVM warm-up only (class loading, JIT): view registration and a trivial
    # job that touches none of the headline queries' data.
    Fixtures(spark, sf_dir)
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for k in keys:
        spark.catalog.clearCache()
        t0 = time.time()
        catalog.QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
        print(f"# {k}: {times[k]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
