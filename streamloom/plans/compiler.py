"""From a graph to DataFrames, and from those to a run.

A vertex is a DataFrame over the union of what it reads.  An edge is nothing
(``fused``, the default: Spark pipelines the vertices into one stage) or an
exchange by the key's stable hash (``exact``: each record is where its key's
hash says).  Operators that hold state by key get the exchange either way.  An
edge whose records are there already, by an exchange before it to as many
partitions, needs none.  A graph over streaming frames compiles in the same
way; ``streaming.graphs`` runs it.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.records import COLUMNS, unkeyed
from ..operators.partitioning import HASH, UnkeyedRecord, exchange, merge
from ..operators.transforms import Filter, Identity
from ..sources.custom import source_records
from ..sources.generator import Generator
from .graph import Graph, Kind, Vertex


class Compiled:
    """The DataFrame that reaches each sink, and what is watched on the way."""

    def __init__(self, spark: SparkSession, graph: Graph, mode: str = "fused"):
        if mode not in ("fused", "exact"):
            raise ValueError(f"mode is 'fused' or 'exact', not {mode!r}")
        self.spark, self.graph, self.mode = spark, graph, mode
        self.order = graph.topological()
        #: Vertex, metric and records of what may have no key.
        self.watched: list[tuple[str, Observation | str, DataFrame]] = []
        self._made: dict[str, DataFrame] = {}
        #: Vertices whose records are in the partition that their key's hash says, of how many.
        self._placed: dict[str, int] = {}
        for v in self.order:
            self._made[v.id] = self._vertex(v)

    def frame(self, sink: str) -> DataFrame:
        return self._made[sink]

    def sinks(self) -> list[Vertex]:
        return [v for v in self.order if v.kind is Kind.SINK]

    def _vertex(self, v: Vertex) -> DataFrame:
        if v.kind is Kind.SOURCE:
            out, keyed = self._source(v)
        else:
            out, keyed = self._fed(v), True
            if v.kind is Kind.OPERATOR:
                if HASH in out.columns and not isinstance(v.operator, (Identity, Filter)):
                    out = out.drop(HASH)
                stateful = out.isStreaming and v.operator.keyed
                out = v.operator.apply_stream(out, v.parallelism) if stateful else v.operator.apply(out)
                keyed = not v.operator.changes_key
                if not keyed:
                    self._placed.pop(v.id, None)
            else:
                out = out.drop(HASH)
        if v.kind is Kind.SINK or keyed:
            return out
        # A filter further down may be pushed below a check in an expression,
        # but not below a metric.
        name = f"{v.id}-{len(self.watched)}"
        counts = F.count_if(unkeyed()).alias("unkeyed"), F.count(F.lit(1)).alias("records")
        if out.isStreaming:
            self.watched.append((v.id, name, out))
            return out.observe(name, *counts)
        seen = Observation(name)
        self.watched.append((v.id, seen, out))
        return out.observe(seen, *counts)

    def _fed(self, v: Vertex) -> DataFrame:
        """What a vertex reads, exchanged where it has to be and isn't yet."""
        above = self.graph.upstream(v.id)
        out = merge([self._made[u] for u in above])
        placed = self._placed.get(above[0]) if len(above) == 1 else None
        stateful = v.kind is Kind.OPERATOR and v.operator.keyed
        # a stream's operator with state groups by itself
        if (self.mode == "exact" or stateful) and placed != v.parallelism and not (out.isStreaming and stateful):
            out, placed = exchange(out, v.parallelism), v.parallelism
        if placed is not None:
            self._placed[v.id] = placed
        return out

    def _source(self, v: Vertex) -> tuple[DataFrame, bool]:
        made = v.source() if callable(v.source) else v.source
        if isinstance(made, Generator):
            if v.parallelism == 1:
                self._placed[v.id] = 1
            hashed = self.mode == "exact" and v.parallelism > 1
            return made.dataframe(self.spark, v.parallelism, hashed=hashed), True
        if isinstance(made, DataFrame):
            return made.select(*COLUMNS), False
        if v.parallelism == 1:
            self._placed[v.id] = 1
        return source_records(self.spark, v.source, v.parallelism, v.id), False


def run(spark: SparkSession, graph: Graph, mode: str = "fused") -> None:
    """Runs each sink of ``graph``.

    Each sink is one Spark action with a plan of its own, so what two sinks
    read is made twice.  Generators and operators without state are cheaper to
    run again than to keep; frames that aren't can be persisted and given as a
    source.  A record without a key that leaves a vertex fails the run, also
    where a later operator would have dropped it; what a sink has written by
    then stays.
    """
    graph.validate()
    for sink in [v for v in graph.topological() if v.kind is Kind.SINK]:
        plan = Compiled(spark, reaching(graph, sink.id), mode)
        sink_instance = sink.sink() if isinstance(sink.sink, type) else sink.sink
        sink_instance.write_all(plan.frame(sink.id))
        for id, seen, records in plan.watched:
            n = _unkeyed(seen, records)
            if n:
                raise UnkeyedRecord(f"vertex {id!r}: {n} records have no key: an unkeyed record has no partition")


def _unkeyed(seen: Observation, records: DataFrame) -> int:
    try:
        return seen.get["unkeyed"]
    except Py4JJavaError:
        # a plan that is empty by its form runs without its metrics
        return records.filter(unkeyed()).count()


def reaching(graph: Graph, sink: str) -> Graph:
    """The part of ``graph`` that ``sink`` reads from."""
    need, todo = {sink}, [sink]
    while todo:
        for id in graph.upstream(todo.pop()):
            if id not in need:
                need.add(id)
                todo.append(id)
    part = Graph({id: v for id, v in graph.vertices.items() if id in need})
    for id in need:
        for up in graph.upstream(id):
            part.connect(up, id)
    return part
