"""Graphs over streams: the same vertices, run batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.partitioning import UnkeyedRecord
from ..plans.compiler import Compiled, reaching
from ..plans.graph import Graph, Kind
from .sinks import to_the_end

#: Several watermarked inputs of a vertex have the least of their watermarks.
POLICY = "spark.sql.streaming.multipleWatermarkPolicy"
_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"


def run_stream(spark: SparkSession, graph: Graph, checkpoint: str, mode: str = "fused") -> None:
    """Runs each sink of ``graph``, whose sources are streaming frames of records, until they have no more.

    Each sink is one streaming query with a folder of its own in
    ``checkpoint``; a later call goes on where this one ended.  A sink gets
    its records by ``write_batch``.  A record without a key that leaves a
    vertex fails the run once its batches are through.
    """
    graph.validate()
    if spark.conf.get(POLICY) != "min":
        raise ValueError(f"{POLICY} has to be min: a vertex's watermark is the least of its inputs'")
    before = spark.conf.get(_PROGRESS)
    spark.conf.set(_PROGRESS, "100000")
    try:
        for sink in [v for v in graph.topological() if v.kind is Kind.SINK]:
            plan = Compiled(spark, reaching(graph, sink.id), mode)
            stream = plan.frame(sink.id)
            if not stream.isStreaming:
                raise ValueError(f"sink {sink.id!r} reads no stream")
            own = sink.sink() if isinstance(sink.sink, type) else sink.sink

            def write(df: DataFrame, batch: int, own=own) -> None:
                own.write_batch(df, batch)

            query = to_the_end(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{sink.id}"))
            for progress in query.recentProgress:
                for id, name, _ in plan.watched:
                    seen = progress.observedMetrics.get(name)
                    if seen is not None and seen["unkeyed"]:
                        raise UnkeyedRecord(f"vertex {id!r}: {seen['unkeyed']} records have no key: an unkeyed record has no partition")
    finally:
        spark.conf.set(_PROGRESS, before)
