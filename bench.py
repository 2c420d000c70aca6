"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from streamloom import queries as core  # noqa: E402
from streamloom.benchmark import measure  # noqa: E402
from streamloom.session import local_session  # noqa: E402

HEADLINE = (
    "identity_events",
    "filter_event_time_mod3",
    "map_rekey",
    "fnv_partition_assignment",
    "partition_record_counts",
    "fan_out_union",
    "multi_input_merge",
    "diamond_counts",
    "keyed_count",
    "tumbling_count",
    "watermark_running",
)
RECORDS = 2_000_000


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus)
    found = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            core.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(median(times), 4)
    for mode in ("fused", "exact"):
        for p in (1, 2, 4, 8):
            found[f"generator_{mode}_p{p}"] = round(measure(spark, RECORDS, p, 1, 10_000, mode)["elapsed_ms"] / 1000, 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 4), "unit": "sec", "queries": found, "sf": os.path.basename(folder.rstrip("/")), "records": RECORDS}))


if __name__ == "__main__":
    main()
