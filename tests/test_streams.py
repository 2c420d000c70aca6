import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from streamloom.sources.generator import Generator, GeneratorConfig
from streamloom.sources.stream import generator_stream
from streamloom.functions.records import Record
from streamloom.operators.partitioning import UnkeyedRecord
from streamloom.operators.sinks import Collect, Table
from streamloom.operators.transforms import NO_WATERMARK, Custom, Filter, Identity, Map, Operator
from streamloom.plans.graph import Graph
from streamloom.sources.generator import record_at
from streamloom.streaming.event_time import late, merged_watermark, running_watermark, tumbling_counts, windowed_stream
from streamloom.streaming.graphs import POLICY, run_stream
from streamloom.streaming.sinks import run_available, run_by_batch, run_complete

C = GeneratorConfig(4, 1200, 8, 1704067200000, 5, 100, 8)


def batch(spark):
    return Generator(C).dataframe(spark, 2, with_offset=True)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("write", [run_available, run_by_batch])
def test_failed_stream_resumes_exactly_once(spark, tmp_path, write):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    with pytest.raises(StreamingQueryException, match="injected failure at offset 700"):
        write(generator_stream(spark, C, 250, 2, fail_at=700), out, mark)
    before = spark.read.parquet(out).count()
    assert 0 < before < 1200
    write(generator_stream(spark, C, 250, 2), out, mark)
    assert same(spark.read.parquet(out).select("key", "value", "event_time", "offset"), batch(spark))
    write(generator_stream(spark, C, 250, 2), out, mark)
    assert spark.read.parquet(out).count() == 1200


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    want = tumbling_counts(batch(spark), 1000)
    got = run_complete(windowed_stream(generator_stream(spark, C, 300), 1000, C.max_lag), "windows")
    assert same(got.select("key", "window_start", "records"), want)
    out = str(tmp_path / "out")
    run_available(windowed_stream(generator_stream(spark, C, 300), 1000, C.max_lag), out, str(tmp_path / "mark"))
    closed = spark.read.parquet(out).select("key", "window_start", "records")
    assert closed.exceptAll(want).count() == 0 and 0 < closed.count() <= want.count()


def test_negative_times_are_refused(spark):
    c = GeneratorConfig(1, 50, 4, -1000, 5, 0, 8)
    with pytest.raises(StreamingQueryException, match="1970"):
        run_complete(windowed_stream(generator_stream(spark, c, 50), 1000, 0), "negative")


def test_windows_floor(spark):
    df = spark.createDataFrame([(b"k", -1), (b"k", -1000), (b"k", 0), (b"k", 999)], "key binary, event_time long")
    assert sorted((r["window_start"], r["records"]) for r in tumbling_counts(df, 1000).collect()) == [(-1000, 2), (0, 2)]


def test_running_watermark(spark):
    got = running_watermark(batch(spark), F.col("offset"), 30, width=64).orderBy("offset").collect()
    top, wm = None, []
    for r in got:
        top = r["event_time"] if top is None else max(top, r["event_time"])
        wm.append(top - 30)
    assert [r["watermark"] for r in got] == wm and len(got) == 1200
    assert late(batch(spark), F.col("offset"), C.max_lag).count() == 0
    assert late(batch(spark), F.col("offset"), 30, ).count() == sum(r["event_time"] < w for r, w in zip(got, wm))


def graph(source, *ops, sink, p=2):
    g = Graph().source("in", source, p)
    for k, o in enumerate(ops):
        g.operator(f"o{k}", o, p)
    return g.sink("out", sink, p).connect("in", *(f"o{k}" for k in range(len(ops))), "out")


ALL = [record_at(C, n) for n in range(1200)]


@pytest.mark.parametrize("mode", ["fused", "exact"])
def test_graph_over_a_stream(spark, tmp_path, mode):
    sink = Collect()
    ops = Identity(), Filter(F.col("event_time") % 2 == 0), Filter(lambda r: r.key[-1] != 3)
    run_stream(spark, graph(generator_stream(spark, C, 300, 2), *ops, sink=sink), str(tmp_path / "mark"), mode)
    assert sorted(sink.records()) == sorted(r for r in ALL if r.event_time % 2 == 0 and r.key[-1] != 3)


def test_graph_goes_on_after_a_failure(spark, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    with pytest.raises(StreamingQueryException, match="offset 700"):
        run_stream(spark, graph(generator_stream(spark, C, 250, 2, fail_at=700), sink=Table(out)), mark)
    for _ in range(2):
        run_stream(spark, graph(generator_stream(spark, C, 250, 2), sink=Table(out)), mark)
        got = spark.read.parquet(out).select("key", "value", "event_time").collect()
        assert sorted((bytes(r[0]), bytes(r[1]), r[2]) for r in got) == sorted(ALL)


class Seen(Operator):
    """Numbers the records of each key; its watermark and how often it was restored go along."""

    def open(self):
        self.counts, self.restored = {}, 0

    def restore(self, data):
        super().restore(data)
        self.restored += 1

    def process(self, record):
        n = self.counts[record.key] = self.counts.get(record.key, 0) + 1
        return [Record(record.key, f"{n} {self.restored} {self.current_watermark}".encode(), record.event_time)]


@pytest.mark.parametrize("lag", [None, 100])
def test_operator_state_is_kept_across_batches_and_runs(spark, tmp_path, lag):
    sinks = [Table(str(tmp_path / "out"))] * 2
    mark = str(tmp_path / "mark")
    with pytest.raises(StreamingQueryException):
        run_stream(spark, graph(generator_stream(spark, C, 300, 2, fail_at=700), Custom(Seen, lag), sink=sinks[0]), mark)
    run_stream(spark, graph(generator_stream(spark, C, 300, 2), Custom(Seen, lag), sink=sinks[1]), mark)
    got = [(bytes(r["key"]), *map(int, r["value"].split()), r["event_time"]) for r in spark.read.parquet(str(tmp_path / "out")).select("key", F.col("value").cast("string"), "event_time").collect()]
    for key in {r.key for r in ALL}:
        assert sorted(n for k, n, *_ in got if k == key) == list(range(1, 1 + sum(r.key == key for r in ALL)))
    assert max(restored for _, _, restored, *_ in got) >= 3
    marks = {w for *_, w, _ in got}
    assert marks == {NO_WATERMARK} if lag is None else len(marks) > 2 and max(marks) <= max(r.event_time for r in ALL) - 100


def test_unkeyed_records_fail_a_stream(spark, tmp_path):
    bad = Map(key=F.when(F.col("event_time") % 10 != 0, F.col("key")))
    with pytest.raises(UnkeyedRecord, match="'o0'"):
        run_stream(spark, graph(generator_stream(spark, C, 300), bad, sink=Collect()), str(tmp_path))


def test_streams_need_the_least_watermark(spark, tmp_path):
    before = spark.conf.get(POLICY)
    spark.conf.set(POLICY, "max")
    try:
        with pytest.raises(ValueError, match="min"):
            run_stream(spark, graph(generator_stream(spark, C, 300), sink=Collect()), str(tmp_path))
    finally:
        spark.conf.set(POLICY, before)


def test_snapshot_and_restore():
    one = Seen()
    one.open()
    for r in ALL[:600]:
        one.process(r)
    two = Seen()
    two.open()
    two.restore(one.snapshot())
    assert [two.process(r)[0].value.split()[0] for r in ALL[600:]] == [one.process(r)[0].value.split()[0] for r in ALL[600:]]


@pytest.mark.parametrize("sources", [1, 2, 3])
def test_merged_watermark(spark, sources):
    source = (F.col("offset") % sources).cast("int")
    got = merged_watermark(batch(spark), F.col("offset"), 30, source, sources, width=16).orderBy("offset").collect()
    tops, want = [None] * sources, []
    for n, r in enumerate(got):
        k = n % sources
        tops[k] = r["event_time"] if tops[k] is None else max(tops[k], r["event_time"])
        want.append(NO_WATERMARK if None in tops else min(tops) - 30)
    assert [r["watermark"] for r in got] == want
