"""Jobs as graphs of sources, operators and sinks, checked before they run."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from enum import Enum

MOST_PARALLELISM = 256


class Kind(Enum):
    SOURCE = "source"
    OPERATOR = "operator"
    SINK = "sink"


class Fault(Enum):
    EMPTY_ID = "a vertex needs an id"
    DUPLICATE_ID = "the id is taken"
    UNKNOWN_VERTEX = "no vertex has this id"
    DUPLICATE_EDGE = "the edge is there already"
    UNKNOWN_KIND = "no such kind of vertex"
    MISSING_PART = "what its kind needs is not set"
    EXTRA_PART = "something is set that its kind doesn't have"
    PARALLELISM_LOW = "parallelism is under 1"
    PARALLELISM_HIGH = f"parallelism is over {MOST_PARALLELISM}"
    SOURCE_WITH_INPUT = "a source has no inputs"
    SINK_WITH_OUTPUT = "a sink has no outputs"
    OPERATOR_WITHOUT_INPUT = "an operator needs an input"
    OPERATOR_WITHOUT_OUTPUT = "an operator needs an output"
    DISCONNECTED = "no edge leads to or from it"
    NO_SOURCE = "the graph has no source"
    NO_SINK = "the graph has no sink"
    CYCLE = "the graph has a cycle"


class GraphError(ValueError):
    def __init__(self, fault: Fault, vertex: str | None = None, detail: str = ""):
        self.fault, self.vertex = fault, vertex
        where = f"vertex {vertex!r}: " if vertex is not None else ""
        super().__init__(f"{where}{fault.value}{': ' if detail else ''}{detail}")


@dataclass(frozen=True)
class Vertex:
    """``source`` makes a DataFrame or a source instance, ``operator`` a transform, ``sink`` a sink."""

    id: str
    kind: Kind
    parallelism: int = 1
    source: object = None
    operator: object = None
    sink: object = None


@dataclass
class Graph:
    vertices: dict[str, Vertex] = field(default_factory=dict)
    _edges: set[tuple[str, str]] = field(default_factory=set)

    def add(self, vertex: Vertex) -> Graph:
        if not vertex.id:
            raise GraphError(Fault.EMPTY_ID)
        if vertex.id in self.vertices:
            raise GraphError(Fault.DUPLICATE_ID, vertex.id)
        self.vertices[vertex.id] = vertex
        return self

    def source(self, id: str, source, parallelism: int = 1) -> Graph:
        return self.add(Vertex(id, Kind.SOURCE, parallelism, source=source))

    def operator(self, id: str, operator, parallelism: int = 1) -> Graph:
        return self.add(Vertex(id, Kind.OPERATOR, parallelism, operator=operator))

    def sink(self, id: str, sink, parallelism: int = 1) -> Graph:
        return self.add(Vertex(id, Kind.SINK, parallelism, sink=sink))

    def connect(self, *path: str) -> Graph:
        """Edges along a path of vertices, one after the other."""
        for a, b in zip(path, path[1:]):
            for id in (a, b):
                if id not in self.vertices:
                    raise GraphError(Fault.UNKNOWN_VERTEX, id)
            if (a, b) in self._edges:
                raise GraphError(Fault.DUPLICATE_EDGE, a, f"to {b!r}")
            self._edges.add((a, b))
        return self

    def downstream(self, id: str) -> list[str]:
        return sorted(b for a, b in self._edges if a == id)

    def upstream(self, id: str) -> list[str]:
        return sorted(a for a, b in self._edges if b == id)

    def validate(self) -> None:
        """Raises the first fault; vertices are looked at in the order of their ids."""
        for id in sorted(self.vertices):
            fault = self._fault(self.vertices[id])
            if fault:
                raise GraphError(fault, id)
        kinds = {v.kind for v in self.vertices.values()}
        for kind, fault in ((Kind.SOURCE, Fault.NO_SOURCE), (Kind.SINK, Fault.NO_SINK)):
            if kind not in kinds:
                raise GraphError(fault)
        self._sorted()

    def _fault(self, v: Vertex) -> Fault | None:
        fed, read = bool(self.upstream(v.id)), bool(self.downstream(v.id))
        parts = {k for k in Kind if getattr(v, k.value) is not None}
        known = isinstance(v.kind, Kind)
        rules = (
            (v.parallelism < 1, Fault.PARALLELISM_LOW),
            (v.parallelism > MOST_PARALLELISM, Fault.PARALLELISM_HIGH),
            (not known, Fault.UNKNOWN_KIND),
            (v.kind not in parts, Fault.MISSING_PART),
            (len(parts) > 1, Fault.EXTRA_PART),
            (v.kind is Kind.SOURCE and fed, Fault.SOURCE_WITH_INPUT),
            (v.kind is Kind.SINK and read, Fault.SINK_WITH_OUTPUT),
            (v.kind is Kind.OPERATOR and not fed, Fault.OPERATOR_WITHOUT_INPUT),
            (v.kind is Kind.OPERATOR and not read, Fault.OPERATOR_WITHOUT_OUTPUT),
            (not fed and not read, Fault.DISCONNECTED),
        )
        return next((fault for broken, fault in rules if broken), None)

    def topological(self) -> list[Vertex]:
        """Vertices after all they read from; of those that can come next, the smallest id."""
        self.validate()
        return [self.vertices[id] for id in self._sorted()]

    def _sorted(self) -> list[str]:
        waits = {id: len(self.upstream(id)) for id in self.vertices}
        ready = [id for id, n in waits.items() if n == 0]
        heapq.heapify(ready)
        out: list[str] = []
        while ready:
            out.append(heapq.heappop(ready))
            for id in self.downstream(out[-1]):
                waits[id] -= 1
                if waits[id] == 0:
                    heapq.heappush(ready, id)
        if len(out) < len(waits):
            left = " ".join(sorted(set(waits) - set(out)))
            raise GraphError(Fault.CYCLE, detail=f"[{left}] remain")
        return out
