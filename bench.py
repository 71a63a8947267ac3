"""Benchmark: headline queries at one scale factor, one JSON line out.

    BENCH_SF_DIR   input tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local[N] (default 8)
    BENCH_REPEATS  timed runs per query, best kept (default 1)
    BENCH_QUERIES  comma list to run a subset (default: the headline set)
    BENCH_EVENT_LOG=1  write Spark's event log (stage/task times) under
                   $BENCH_EVENT_LOG_DIR (default /tmp/checkpoints)

Each query's result is fully computed through the ``noop`` sink (every row
produced, nothing collected).  Warm-up queries (one batch, one streaming)
run first so JVM start and first-use class loading are not billed to any
query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidepool.plans.catalog import REGISTRY  # noqa: E402
from tidepool.session import local_session  # noqa: E402

HEADLINE = [
    "topic_replay",
    "topic_counts",
    "json_flatten",
    "malformed_skipped",
    "attributes",
    "series_by_time",
    "series_by_time_stream",
    "latest_message",
    "latest_message_stream",
    "bar_by_x",
    "new_rows",
    "natural_join",
    "rmse_validation",
    "class_metrics",
    "model_nb",
    "running_rmse",
    "stream_topic_rmse",
    "stream_running_rmse",
    "model_as_of",
    "model_registry_latest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    extra = {}
    if os.environ.get("BENCH_EVENT_LOG"):
        # stage and task timings, read offline from the event log
        log_dir = os.path.join(os.environ.get("BENCH_EVENT_LOG_DIR", "/tmp/checkpoints"), "tidepool-eventlog")
        os.makedirs(log_dir, exist_ok=True)
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir}
    spark = local_session(cpus=cpus, shuffle_partitions=max(8, int(cpus)), app="tidepool-bench", extra=extra)

    # warm-up: one batch query and one streaming query (on the smallest
    # tables present), so neither engine's first-use cost is billed
    REGISTRY["bar_by_x"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = small if os.path.isdir(small) else sf_dir
    REGISTRY["topic_counts"].run(spark, warm_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(repeats):
            t0 = time.perf_counter()
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
        print(f"# {name}: {best:.2f}s", file=sys.stderr, flush=True)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "repeats": repeats,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
