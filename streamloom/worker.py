"""python -m streamloom.worker --job identity: runs one job and checks that nothing was lost."""

from __future__ import annotations

import argparse
import sys
import time

from .operators.sinks import Collect
from .operators.transforms import Identity
from .plans.compiler import run
from .plans.graph import Graph
from .session import local_session
from .sources.generator import Generator, GeneratorConfig

BASE = 1704067200000  # 2024-01-01 UTC


def identity_graph(sink, records: int, seed: int, keys: int, parallelism: int = 1) -> Graph:
    config = GeneratorConfig(seed=seed, count=records, key_cardinality=keys, base_event_time=BASE, event_time_step=1, max_lag=500, value_size=16)
    g = Graph().source("source", Generator(config), parallelism).operator("identity", Identity(), parallelism).sink("sink", sink, parallelism)
    return g.connect("source", "identity", "sink")


JOBS = {"identity": identity_graph}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="streamloom.worker")
    p.add_argument("--job", default="identity")
    p.add_argument("--records", type=int, default=100_000)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--keys", type=int, default=1000)
    p.add_argument("--cores", type=int, default=4)
    o = p.parse_args(args)
    if o.job not in JOBS:
        print(f"unknown job {o.job!r}; there are {', '.join(JOBS)}", file=sys.stderr)
        return 1
    sink = Collect()
    graph = JOBS[o.job](sink, o.records, o.seed, o.keys)
    spark = local_session("worker", o.cores)
    began = time.perf_counter()
    run(spark, graph)
    written = len(sink.records())
    print(f"job={o.job} records={o.records} written={written} elapsed={time.perf_counter() - began:.3f}s")
    if written != o.records:
        print(f"{o.records - written} records were lost", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
