"""python -m streamloom.benchmark: records a second by parallelism, against a baseline file."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from .operators.sinks import Discard
from .plans.compiler import run
from .session import local_session
from .worker import identity_graph


def levels(text: str) -> list[int]:
    """Parallelism levels of a comma-separated list; blanks are skipped."""
    out = [int(x) for x in text.split(",") if x.strip()]
    if not out or min(out) < 1:
        raise ValueError(f"levels are numbers from 1, not {text!r}")
    return out


def measure(spark: SparkSession, records: int, parallelism: int, seed: int, keys: int, mode: str = "fused", times: int = 3) -> dict:
    """The median of ``times`` runs; only the run is timed."""
    seconds = []
    for _ in range(times):
        graph = identity_graph(Discard(), records, seed, keys, parallelism)
        began = time.perf_counter()
        run(spark, graph, mode)
        seconds.append(time.perf_counter() - began)
    s = median(seconds)
    return {"parallelism": parallelism, "records": records, "elapsed_ms": round(s * 1000), "records_per_sec": records / s}


def report(spark: SparkSession, records: int, at: list[int], seed: int, keys: int, mode: str) -> dict:
    measure(spark, min(records, 100_000), max(at), seed, keys, mode, times=2)  # compiled before it counts
    return {"mode": mode, "cpus": os.cpu_count(), "results": [measure(spark, records, p, seed, keys, mode) for p in at]}


def compare(got: dict, want: dict, threshold: float) -> list[str]:
    """Levels that are more than ``threshold`` percent slower; those that the baseline lacks are skipped."""
    base = {r["parallelism"]: r["records_per_sec"] for r in want["results"]}
    out = []
    for r in got["results"]:
        if r["parallelism"] in base:
            change = 100 * (r["records_per_sec"] / base[r["parallelism"]] - 1)
            print(f"parallelism {r['parallelism']}: {r['records_per_sec']:.0f} rec/s, {change:+.1f}% against the baseline")
            if change < -threshold:
                out.append(f"parallelism {r['parallelism']} is {-change:.1f}% slower")
    return out


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="streamloom.benchmark")
    p.add_argument("--records", type=int, default=2_000_000)
    p.add_argument("--parallelism", type=levels, default="1,2,4,8")
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--keys", type=int, default=10_000)
    p.add_argument("--mode", choices=("fused", "exact"), default="fused")
    p.add_argument("--json", help="write the report here")
    p.add_argument("--baseline", help="compare with the report in this file")
    p.add_argument("--threshold", type=float, default=15.0)
    o = p.parse_args(args)
    at = levels(o.parallelism) if isinstance(o.parallelism, str) else o.parallelism
    got = report(local_session("benchmark", max(at)), o.records, at, o.seed, o.keys, o.mode)
    first = next((r["records_per_sec"] for r in got["results"] if r["parallelism"] == 1), None)
    for r in got["results"]:
        scale = f", {r['records_per_sec'] / first:.2f}x" if first else ""
        print(f"parallelism {r['parallelism']}: {r['records_per_sec']:.0f} rec/s{scale}")
    if o.json:
        with open(o.json, "w") as f:
            json.dump(got, f, indent=2)
    if o.baseline:
        with open(o.baseline) as f:
            slower = compare(got, json.load(f), o.threshold)
        if slower:
            print("; ".join(slower), file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
