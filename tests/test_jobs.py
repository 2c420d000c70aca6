import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from streamloom.operators.sinks import Collect, Discard, Each, Table, Writer
from streamloom.operators.transforms import Custom, Filter, FlatMap, Identity, Map, Operator
from streamloom.functions.bits import wrapping
from streamloom.operators.partitioning import UnkeyedRecord, partition_of
from streamloom.functions.records import Record
from streamloom.plans.compiler import Compiled, run
from streamloom.plans.graph import Fault, Graph, GraphError, Kind, Vertex
from streamloom.sources.generator import Generator, GeneratorConfig, record_at

C = GeneratorConfig(7, 500, 16, 1700000000000, 10, 50, 8)
OTHER = GeneratorConfig(8, 500, 16, 1700000000000, 10, 50, 8)
ALL = [record_at(C, n) for n in range(500)]


def src(id, p=1):
    return Vertex(id, Kind.SOURCE, p, source=Generator(C))


def op(id, p=1):
    return Vertex(id, Kind.OPERATOR, p, operator=Identity())


def out(id, p=1):
    return Vertex(id, Kind.SINK, p, sink=Discard())


def graph(vertices, *paths):
    g = Graph()
    for v in vertices:
        g.add(v)
    for p in paths:
        g.connect(*p)
    return g


@pytest.mark.parametrize(
    "fault, vertices, paths",
    [
        (Fault.EMPTY_ID, [src("")], []),
        (Fault.DUPLICATE_ID, [src("a"), op("a")], []),
        (Fault.UNKNOWN_VERTEX, [src("a")], [("a", "b")]),
        (Fault.UNKNOWN_VERTEX, [src("a")], [("b", "a")]),
        (Fault.DUPLICATE_EDGE, [src("a"), out("b")], [("a", "b"), ("a", "b")]),
        (Fault.UNKNOWN_KIND, [Vertex("a", "other", 1, source=Generator(C)), out("b")], [("a", "b")]),
        (Fault.MISSING_PART, [Vertex("a", Kind.SOURCE), out("b")], [("a", "b")]),
        (Fault.MISSING_PART, [Vertex("a", Kind.SOURCE, 1, sink=Discard()), out("b")], [("a", "b")]),
        (Fault.EXTRA_PART, [Vertex("a", Kind.SOURCE, 1, source=Generator(C), sink=Discard()), out("b")], [("a", "b")]),
        (Fault.PARALLELISM_LOW, [src("a", 0), out("b")], [("a", "b")]),
        (Fault.PARALLELISM_HIGH, [src("a", 257), out("b")], [("a", "b")]),
        (Fault.SOURCE_WITH_INPUT, [src("a"), src("b"), out("c")], [("a", "b", "c")]),
        (Fault.SINK_WITH_OUTPUT, [src("a"), out("b"), out("c")], [("a", "b", "c")]),
        (Fault.OPERATOR_WITHOUT_INPUT, [src("s"), op("a"), out("b")], [("a", "b"), ("s", "b")]),
        (Fault.OPERATOR_WITHOUT_OUTPUT, [src("s"), op("a"), out("b")], [("s", "a"), ("s", "b")]),
        (Fault.DISCONNECTED, [src("s"), out("b"), src("z")], [("s", "b")]),
        (Fault.NO_SOURCE, [], []),
        (Fault.NO_SINK, [src("s"), op("a"), op("b")], [("s", "a", "b", "a")]),
        (Fault.CYCLE, [src("s"), op("a"), op("b"), out("k")], [("s", "a", "b", "a"), ("b", "k")]),
        (Fault.CYCLE, [src("s"), op("a"), out("k")], [("s", "a", "a"), ("a", "k")]),
    ],
)
def test_faults(fault, vertices, paths):
    with pytest.raises(GraphError) as e:
        graph(vertices, *paths).validate()
    assert e.value.fault is fault


def test_no_sink():
    with pytest.raises(GraphError) as e:
        Graph().source("s", Generator(C)).operator("a", Identity()).connect("s", "a").validate()
    assert e.value.fault is Fault.OPERATOR_WITHOUT_OUTPUT


def test_cycle_message():
    with pytest.raises(GraphError, match=r"\[a b k\] remain"):
        graph([src("s"), op("a"), op("b"), out("k")], ("s", "a", "b", "a"), ("b", "k")).validate()


def test_order_and_edges():
    g = graph([src("s"), op("b"), op("a"), out("z")], ("s", "b", "z"), ("s", "a", "z"))
    assert [v.id for v in g.topological()] == ["s", "a", "b", "z"]
    assert g.downstream("s") == ["a", "b"] and g.downstream("none") == []


def test_limits_of_parallelism():
    for p in (1, 256):
        graph([src("a", p), out("b", p)], ("a", "b")).validate()


def chain(sink, *ops, source=None, p=1):
    g = Graph().source("in", source or Generator(C), p)
    for k, o in enumerate(ops):
        g.operator(f"o{k}", o, p)
    return g.sink("out", sink, p).connect("in", *(f"o{k}" for k in range(len(ops))), "out")


def topologies(sink, p):
    two = Graph().source("a", Generator(C), p).source("b", Generator(OTHER), p).operator("m", Identity(), p).sink("k", sink, p)
    fan = Graph().source("a", Generator(C), p).operator("l", Identity(), p).operator("r", Identity(), p).sink("k", sink, p)
    other = [record_at(OTHER, n) for n in range(500)]
    return {
        "chain": (chain(sink, Identity(), p=p), ALL),
        "direct": (chain(sink, p=p), ALL),
        "fan_out": (fan.connect("a", "l", "k").connect("a", "r", "k"), ALL * 2),
        "multi": (two.connect("a", "m", "k").connect("b", "m"), ALL + other),
    }


@pytest.mark.parametrize("mode", ["fused", "exact"])
@pytest.mark.parametrize("p", [1, 2, 4, 8])
@pytest.mark.parametrize("name", ["chain", "direct", "fan_out", "multi"])
def test_contents_do_not_depend_on_parallelism(spark, name, p, mode):
    sink = Collect()
    g, want = topologies(sink, p)[name]
    run(spark, g, mode)
    assert sorted(sink.records()) == sorted(want)


def test_branches_get_everything(spark):
    a, b = Collect(), Collect()
    g = Graph().source("s", Generator(C)).operator("e", Filter(F.col("event_time") % 2 == 0)).sink("a", a).sink("b", b)
    run(spark, g.connect("s", "e", "a").connect("s", "b"))
    assert sorted(b.records()) == sorted(ALL) and sorted(a.records()) == sorted(r for r in ALL if r.event_time % 2 == 0)
    a.records().clear()
    assert a.records()


def test_map(spark):
    def collected(*ops):
        sink = Collect()
        run(spark, chain(sink, *ops))
        return sorted(sink.records())

    drop = lambda r: None if r.event_time % 3 else r._replace(value=b"v")
    want = sorted(r._replace(value=b"v") for r in ALL if r.event_time % 3 == 0)
    assert collected(Map(drop)) == want
    assert collected(Map(keep=F.when(F.col("event_time") % 3 == 0, F.lit(True)), value=F.lit("v"))) == want
    assert collected(Filter(lambda r: r.key[-1] == 3)) == sorted(r for r in ALL if r.key[-1] == 3)
    assert collected(Filter(F.lit(None).cast("boolean"))) == []
    assert collected(Map(event_time=F.col("event_time") - 10**13)) == sorted(r._replace(event_time=r.event_time - 10**13) for r in ALL)
    twice = FlatMap(F.array(*[F.struct("key", F.lit(x).alias("value"), "event_time") for x in "ab"]))
    assert len(collected(twice)) == 1000

    def failing(r):
        raise RuntimeError("no such luck")

    with pytest.raises(PythonException, match="no such luck"):
        collected(Map(failing))


class Count(Operator):
    def open(self):
        self.n = {}

    def process(self, record):
        self.n[record.key] = self.n.get(record.key, 0) + 1
        return ()

    def end_of_stream(self):
        return [Record(k, str(n).encode(), 0) for k, n in self.n.items()]


@pytest.mark.parametrize("p", [1, 4])
def test_custom_operator_sees_all_of_a_key(spark, p):
    sink = Collect()
    run(spark, chain(sink, Custom(Count), p=p))
    want = {}
    for r in ALL:
        want[r.key] = want.get(r.key, 0) + 1
    assert sorted((r.key, int(r.value)) for r in sink.records()) == sorted(want.items())


def test_unkeyed_records_fail_the_run(spark, tmp_path):
    rows = [(bytes([k]), b"v", k) for k in range(1, 100)]
    path = str(tmp_path / "in")
    spark.createDataFrame([*rows, (b"", b"v", 7)], "key binary, value binary, event_time long").write.parquet(path)
    df = spark.read.parquet(path)
    later = Filter(F.col("event_time") > 50)
    for p, mode in ((1, "fused"), (2, "exact")):
        with pytest.raises(UnkeyedRecord, match="'in'"):
            run(spark, chain(Collect(), later, source=df, p=p), mode)
    with pytest.raises(UnkeyedRecord, match="'o0'"):
        run(spark, chain(Collect(), Map(key=F.lit(None).cast("binary")), later))
    with pytest.raises(UnkeyedRecord):
        run(spark, chain(Discard(), Map(lambda r: r._replace(key=b"")), later))
    good = Collect()
    run(spark, chain(good, later, source=df.filter("octet_length(key) > 0")))
    assert len(good.records()) == 49


class Files(Writer):
    def __init__(self, folder):
        self.folder = folder

    def open(self):
        self.held = []

    def write(self, record):
        if record.value == b"bad":
            raise ValueError("will not write this")
        self.held.append(record)

    def close(self):
        import os
        import uuid

        open(os.path.join(self.folder, uuid.uuid4().hex), "w").write(str(len(self.held)))


def test_sinks(spark, tmp_path):
    folder = tmp_path / "each"
    folder.mkdir()
    sink = Each(lambda f=str(folder): Files(f))
    run(spark, chain(sink, p=4))
    assert sink.written == 500 and sum(int(p.read_text()) for p in folder.iterdir()) == 500
    with pytest.raises(PythonException, match="will not write"):
        run(spark, chain(sink, Map(value=F.lit("bad"))))
    run(spark, chain(Table(str(tmp_path / "t"))))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 500


def test_fused_plans_have_no_exchange(spark):
    plan = lambda mode, p=4, ops=(Identity(),): Compiled(spark, chain(Discard(), *ops, p=p), mode).frame("out")._jdf.queryExecution().executedPlan().toString()
    # records stay where the first exchange has put them
    assert "Exchange" not in plan("fused") and plan("exact").count("Exchange") == 1
    assert plan("exact", ops=(Identity(), Filter(F.col("event_time") > 0))).count("Exchange") == 1
    assert plan("exact", ops=(Map(key=F.col("value")),)).count("Exchange") == 2
    assert "Exchange" not in plan("exact", p=1)
    with pytest.raises(ValueError):
        Compiled(spark, chain(Discard()), "other")


@pytest.mark.parametrize("case", range(4))
def test_exact_placement(spark, case):
    ops = [
        (Identity(),),
        (Identity(), Filter(F.col("event_time") % 2 == 0)),
        (Map(key=F.col("value")), Identity()),
        (Map(event_time=F.col("event_time") + 1),),
    ][case]
    frame = Compiled(spark, chain(Discard(), *ops, p=8), "exact").frame("out")
    assert frame.columns == ["key", "value", "event_time"]
    with wrapping(spark):
        got = frame.select(F.spark_partition_id().alias("at"), partition_of(F.col("key"), 8).alias("want"))
        assert got.filter("at != want").count() == 0 and frame.count() > 0
