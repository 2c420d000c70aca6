"""The queries of the engine's own operators, with their DuckDB oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import suppress

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bits import GAMMA, MIX_A, MIX_B, big_endian, fnv1a_of_long, mod_unsigned, wrapping
from .functions.records import COLUMNS, Record, event_records, millis, printable
from .operators.partitioning import UnkeyedRecord, partition_counts, with_partition
from .operators.sinks import Discard, Each, Table, Writer
from .operators.transforms import Custom, Filter, FlatMap, Identity, Map, Operator
from .plans.compiler import Compiled, run
from .plans.graph import Graph
from .session import shared_folder
from .sources.custom import Source
from .sources.generator import Generator, GeneratorConfig, slice_of
from .sources.stream import generator_stream
from .streaming.event_time import keyed_counts, late, merged_watermark, running_watermark, tumbling_counts
from .streaming.graphs import run_stream
from .streaming.sinks import run_available, run_by_batch

#: The records that the worker and the benchmark make.
WORKER = GeneratorConfig(seed=1, count=20_000, key_cardinality=1000, base_event_time=1704067200000, event_time_step=1, max_lag=500, value_size=16)
#: The records that streams make.
STREAM = GeneratorConfig(seed=3, count=6000, key_cardinality=40, base_event_time=1704067200000, event_time_step=5, max_lag=500, value_size=16)
DAY = 86_400_000
PARTITIONS = 8
#: Length of the windows that a stream's operator closes.
SECOND = 1000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_records(_events(spark, sf_dir))


def _job(spark: SparkSession, graph: Graph, mode: str = "fused") -> DataFrame:
    plan = Compiled(spark, graph, mode)
    return plan.frame(plan.sinks()[0].id)


def _graph(source, *operators, sink=None, p: int = 1) -> Graph:
    g = Graph().source("in", source, p)
    for k, op in enumerate(operators):
        g.operator(f"op{k}", op, p)
    g.sink("out", sink or Discard(), p)
    return g.connect("in", *(f"op{k}" for k in range(len(operators))), "out")


def _chain(spark: SparkSession, source: DataFrame, *operators) -> DataFrame:
    return _job(spark, _graph(source, *operators))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def identity_events(spark, sf_dir):
    return printable(_chain(spark, _records(spark, sf_dir), Identity()))


def filter_event_time_mod3(spark, sf_dir):
    return printable(_chain(spark, _records(spark, sf_dir), Filter(F.col("event_time") % 3 == 0)))


def filter_drop_all(spark, sf_dir):
    return printable(_chain(spark, _records(spark, sf_dir), Filter(F.lit(False))))


def map_uppercase_value(spark, sf_dir):
    e = _events(spark, sf_dir)
    r = e.select(big_endian(F.col("user_id")).alias("key"), F.col("event_type").cast("binary").alias("value"), millis(F.col("ts")).alias("event_time"))
    return printable(_chain(spark, r, Map(value=F.upper(F.col("value").cast("string")))))


def map_drop_null(spark, sf_dir):
    keep = F.when(F.col("event_time") % 2 == 0, F.lit(True))
    return printable(_chain(spark, _records(spark, sf_dir), Map(keep=keep, event_time=F.col("event_time") + 1)))


def map_rekey(spark, sf_dir):
    second = F.col("event_time") % 97
    out = _chain(spark, _records(spark, sf_dir), Map(key=big_endian(second)))
    return printable(with_partition(out, PARTITIONS), "partition")


def flat_map(spark, sf_dir):
    copies = F.transform(
        F.slice(F.sequence(F.lit(0), F.lit(2)), F.lit(1), (F.col("event_time") % 3).cast("int")),
        lambda k: F.struct(F.col("key").alias("key"), F.col("value").alias("value"), (F.col("event_time") + k).alias("event_time")),
    )
    return printable(_chain(spark, _records(spark, sf_dir), FlatMap(copies)))


def _generated(spark, offset: int = 0, with_offset: bool = True) -> DataFrame:
    return Generator(WORKER).dataframe(spark, spark.sparkContext.defaultParallelism, offset, with_offset)


def _hexed(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.lower(F.hex("key")).alias("key"), F.lower(F.hex("value")).alias("value"), "event_time", *more)


def generator_rows(spark, sf_dir):
    return _hexed(_generated(spark), "offset")


def generator_seek(spark, sf_dir):
    return _hexed(_generated(spark, offset=15_000), "offset")


def generator_key_cardinality(spark, sf_dir):
    return _generated(spark).agg(F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("records"))


def generator_lag_bound(spark, sf_dir):
    lag = F.lit(WORKER.base_event_time) + F.col("offset") * WORKER.event_time_step - F.col("event_time")
    return _generated(spark).agg(F.min(lag).alias("min_lag"), F.max(lag).alias("max_lag"))


def source_ranges(spark, sf_dir):
    count = 10
    rows = [(p, i, *slice_of(count, p, i)) for p in (1, 2, 4, 8) for i in range(p)]
    return spark.createDataFrame(rows, "parallelism long, reader long, start_offset long, end_offset long")


def source_partition_rows(spark, sf_dir):
    df = Generator(WORKER).dataframe(spark, PARTITIONS, with_offset=True)
    return df.groupBy(F.spark_partition_id().alias("reader")).agg(F.min("offset").alias("first_offset"), F.count(F.lit(1)).alias("records"))


def fnv_partition_assignment(spark, sf_dir):
    with wrapping(spark):
        e = _events(spark, sf_dir).select("event_id", "user_id", fnv1a_of_long(F.col("user_id")).alias("h"))
        return e.select("event_id", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("hash"), mod_unsigned(F.col("h"), PARTITIONS).alias("partition"))


def partition_record_counts(spark, sf_dir):
    return partition_counts(_records(spark, sf_dir), PARTITIONS)


def fan_out_union(spark, sf_dir):
    g = Graph().source("in", _records(spark, sf_dir)).operator("left", Identity()).operator("right", Identity()).sink("out", object())
    return printable(_job(spark, g.connect("in", "left", "out").connect("in", "right", "out")))


def fan_out_branches(spark, sf_dir):
    even = Filter(F.col("event_time") % 2 == 0)
    odd = Map(keep=F.col("event_time") % 2 == 1, value=F.lit("odd"))
    g = Graph().source("in", _records(spark, sf_dir)).operator("even", even).operator("odd", odd).sink("out", object())
    return printable(_job(spark, g.connect("in", "even", "out").connect("in", "odd", "out")))


def multi_input_merge(spark, sf_dir):
    other = GeneratorConfig(**{**WORKER.__dict__, "seed": 2})
    g = Graph().source("a", Generator(WORKER), 4).source("b", Generator(other), 4).operator("merge", Identity(), 4).sink("out", object())
    return _hexed(_job(spark, g.connect("a", "merge", "out").connect("b", "merge")))


def diamond_counts(spark, sf_dir):
    g = Graph().source("in", _records(spark, sf_dir)).operator("l", Identity()).operator("r", Identity()).operator("join", Identity()).sink("out", object())
    out = _job(spark, g.connect("in", "l", "join", "out").connect("in", "r", "join"))
    return out.groupBy(F.lower(F.hex("key")).alias("key")).agg(F.count(F.lit(1)).alias("records"))


def keyed_count(spark, sf_dir):
    out = keyed_counts(_records(spark, sf_dir))
    return out.select(F.lower(F.hex("key")).alias("key"), "records", "value_bytes")


class KeyedSum(Operator):
    """Adds up the values of each key, and gives the sums at the end."""

    def open(self):
        self.sums = {}

    def process(self, record):
        total, last = self.sums.get(record.key, (0, record.event_time))
        self.sums[record.key] = total + int(record.value), max(last, record.event_time)
        return ()

    def end_of_stream(self):
        return [Record(k, str(total).encode(), last) for k, (total, last) in self.sums.items()]


class RunningCount(Operator):
    """Each record with how many its key has had so far as its value."""

    def open(self):
        self.counts = {}

    def process(self, record):
        n = self.counts[record.key] = self.counts.get(record.key, 0) + 1
        return [record._replace(value=str(n).encode())]


class WindowCount(Operator):
    """The records of each key in each window of a second, once the watermark has passed its end."""

    def open(self):
        self.windows = {}

    def process(self, record):
        at = record.key, record.event_time // SECOND * SECOND
        self.windows[at] = self.windows.get(at, 0) + 1
        return ()

    def process_watermark(self, watermark):
        closed = [at for at in self.windows if at[1] + SECOND <= watermark]
        return [Record(key, str(self.windows.pop((key, start))).encode(), start) for key, start in closed]


class Squares(Source):
    """n with its square, for n below 5,000."""

    def __init__(self):
        self.at = 0

    def count(self):
        return 5000

    def next(self):
        if self.at >= self.count():
            return None
        self.at += 1
        n = self.at - 1
        return Record((n % 100).to_bytes(8, "big"), str(n * n).encode(), n)

    def seek_to(self, offset):
        self.at = offset

    def position(self):
        return self.at


class NullWriter(Writer):
    def write(self, record):
        pass


def keyed_sum_flush(spark, sf_dir):
    e = _events(spark, sf_dir)
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string").cast("binary")
    r = e.select(big_endian(F.col("user_id")).alias("key"), cents.alias("value"), millis(F.col("ts")).alias("event_time"))
    out = _job(spark, _graph(r, Custom(KeyedSum), p=PARTITIONS))
    return printable(out).select("key", F.col("value").cast("bigint").alias("cents"), F.col("event_time").alias("last_event_time"))


def exchange_placement(spark, sf_dir):
    out = _job(spark, _graph(_records(spark, sf_dir), Identity(), p=PARTITIONS), "exact")
    return printable(out.withColumn("partition", F.spark_partition_id()), "partition")


def custom_source(spark, sf_dir):
    return printable(_job(spark, _graph(Squares, Identity(), p=4)))


def table_sink(spark, sf_dir):
    path = _folder(spark, "table-sink")
    run(spark, _graph(_records(spark, sf_dir), Filter(F.col("event_time") % 2 == 0), sink=Table(path)))
    return printable(spark.read.parquet(path))


def each_sink(spark, sf_dir):
    sink = Each(NullWriter)
    run(spark, _graph(_records(spark, sf_dir), sink=sink, p=4))
    return spark.createDataFrame([(sink.written,)], "written long")


def unkeyed_rejected(spark, sf_dir):
    bad = _records(spark, sf_dir).withColumn("key", F.when(F.col("event_time") % 10 != 0, F.col("key")))
    rejected = False
    try:
        run(spark, _graph(bad, Filter(F.lit(False))))
    except UnkeyedRecord:
        rejected = True
    return spark.createDataFrame([(rejected,)], "rejected boolean")


def _failing_then_whole(spark, write: Callable[[DataFrame], None]) -> None:
    """A stream that fails in its second batch, and another that goes on."""
    with suppress(StreamingQueryException):
        write(generator_stream(spark, STREAM, 2000, 2, fail_at=3500))
    write(generator_stream(spark, STREAM, 2000, 2))


def stream_resume(spark, sf_dir):
    path, mark = _folder(spark, "stream"), _folder(spark, "mark")
    _failing_then_whole(spark, lambda s: run_available(s, path, mark))
    return _hexed(spark.read.parquet(path), "offset")


def stream_exactly_once(spark, sf_dir):
    path, mark = _folder(spark, "stream"), _folder(spark, "mark")
    _failing_then_whole(spark, lambda s: run_by_batch(s, path, mark))
    return _hexed(spark.read.parquet(path), "offset")


def stream_graph(spark, sf_dir):
    path, mark = _folder(spark, "stream"), _folder(spark, "mark")
    even, odd = Filter(F.col("event_time") % 2 == 0), Map(keep=F.col("event_time") % 2 == 1, event_time=-F.col("event_time"))
    g = Graph().source("in", generator_stream(spark, STREAM, 2000, 2)).operator("even", even).operator("odd", odd).sink("out", Table(path))
    run_stream(spark, g.connect("in", "even", "out").connect("in", "odd", "out"), mark)
    return _hexed(spark.read.parquet(path).select(*COLUMNS))


def stream_keyed_state(spark, sf_dir):
    path, mark = _folder(spark, "stream"), _folder(spark, "mark")
    _failing_then_whole(spark, lambda s: run_stream(spark, _graph(s, Custom(RunningCount), sink=Table(path), p=4), mark))
    out = spark.read.parquet(path)
    return out.groupBy(F.lower(F.hex("key")).alias("key")).agg(F.max(F.col("value").cast("string").cast("bigint")).alias("last_count"), F.count_distinct("value").alias("counts"))


def stream_windows(spark, sf_dir):
    path, mark = _folder(spark, "stream"), _folder(spark, "mark")
    run_stream(spark, _graph(generator_stream(spark, STREAM, 2000, 2), Custom(WindowCount, lag=STREAM.max_lag), sink=Table(path), p=4), mark)
    out = spark.read.parquet(path)
    return out.select(F.lower(F.hex("key")).alias("key"), F.col("event_time").alias("window_start"), F.col("value").cast("string").cast("bigint").alias("records"))


def merged_inputs_watermark(spark, sf_dir):
    r = _events(spark, sf_dir).select("event_id", millis(F.col("ts")).alias("event_time"))
    out = merged_watermark(r, F.col("event_id"), 500, (F.col("event_id") % 3).cast("int"), 3)
    return out.select("event_id", "watermark")


def watermark_running(spark, sf_dir):
    r = _events(spark, sf_dir).select("event_id", millis(F.col("ts")).alias("event_time"))
    return running_watermark(r, F.col("event_id"), 500).select("event_id", "event_time", "watermark")


def tumbling_count(spark, sf_dir):
    out = tumbling_counts(_records(spark, sf_dir), DAY)
    return out.select(F.lower(F.hex("key")).alias("key"), "window_start", "records")


def tumbling_count_negative(spark, sf_dir):
    r = _records(spark, sf_dir).withColumn("event_time", F.col("event_time") - 1705000000000)
    return tumbling_counts(r, DAY).groupBy("window_start").agg(F.sum("records").alias("records"))


def late_by_watermark(spark, sf_dir):
    return late(_generated(spark), F.col("offset"), 250).select("offset", "event_time", "watermark")


_EVENT = "lpad(lower(hex(user_id)), 16, '0')"
_MS = "epoch_us(ts) // 1000"
_BASE = f"select {_EVENT} as key, props as value, {_MS} as event_time from events"
_M64 = "18446744073709551616::uhugeint"


def _mul(a: str, b: int) -> str:
    """a * b modulo 2**64 on UHUGEINT, in halves of b so that nothing overflows."""
    return f"(({a} * {b & 0xFFFFFFFF}::uhugeint + (({a} * {b >> 32}::uhugeint) % {_M64} % 4294967296::uhugeint) * 4294967296::uhugeint) % {_M64})"


def _mix_ctes(name: str, source: str, seed: str, n: str) -> str:
    """Three steps of the mixing function, each a table, ending in ``name`` with column m."""
    g = _mul(f"({n} + 1)::uhugeint", GAMMA)
    return f"""
{name}0 as (select *, (({seed})::uhugeint + {g}) % {_M64} as z from {source}),
{name}1 as (select * exclude z, xor(z, z >> 30) as z from {name}0),
{name}2 as (select * exclude z, {_mul('z', MIX_A)} as z from {name}1),
{name}3 as (select * exclude z, xor(z, z >> 27) as z from {name}2),
{name}4 as (select * exclude z, {_mul('z', MIX_B)} as z from {name}3),
{name} as (select * exclude z, xor(z, z >> 31) as m from {name}4)"""


def _generator_sql(c: GeneratorConfig, tail: str, first: int = 0) -> str:
    hexed = lambda x: f"lpad(lower(hex(({x})::ubigint)), 16, '0')"
    return f"""
with n as (select i as "offset" from range({first}, {c.count}) r(i)),
{_mix_ctes('k', 'n', str(c.seed ^ 1), '"offset"')},
kk as (select * exclude m, m % {c.key_cardinality} as k from k),
{_mix_ctes('t', 'kk', str(c.seed ^ 3), '"offset"')},
tt as (select * exclude m, ({c.base_event_time} + "offset" * {c.event_time_step} - (m % {c.max_lag + 1})::bigint)::bigint as event_time from t),
{_mix_ctes('b', 'tt', str(c.seed ^ 2), '"offset"')},
bb as (select * exclude m, m as base from b),
{_mix_ctes('va', 'bb', 'base', '0')},
vaa as (select * exclude m, m as va from va),
{_mix_ctes('vb', 'vaa', 'base', '1')},
g as (select {hexed('k')} as key, {hexed('va')} || {hexed('m')} as value, event_time, "offset" from vb)
{tail}"""


def _fnv_ctes() -> str:
    out, last = ["f0 as (select event_id, user_id, 14695981039346656037::uhugeint as h from events)"], "f0"
    for k, shift in enumerate(range(56, -8, -8), 1):
        byte = f"((user_id >> {shift}) & 255)::uhugeint"
        out.append(f"f{k} as (select event_id, user_id, {_mul(f'xor(h, {byte})', 1099511628211)} as h from {last})")
        last = f"f{k}"
    return ",\n".join(out)


def _fnv_of_mod() -> str:
    out, last = ["r as (select lpad(lower(hex(k)), 16, '0') as key, k, value, event_time, 14695981039346656037::uhugeint as h from (select *, event_time % 97 as k from e))"], "r"
    for j, shift in enumerate(range(56, -8, -8), 1):
        byte = f"((k >> {shift}) & 255)::uhugeint"
        out.append(f"r{j} as (select key, k, value, event_time, {_mul(f'xor(h, {byte})', 1099511628211)} as h from {last})")
        last = f"r{j}"
    return ",\n".join(out)


def _ranges_sql() -> str:
    return """
select p as parallelism, i as reader, (i * 10) // p as start_offset, ((i + 1) * 10) // p as end_offset
from (select unnest([1, 2, 4, 8])::bigint as p), lateral (select unnest(range(p)) as i)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        identity_events, filter_event_time_mod3, filter_drop_all, map_uppercase_value, map_drop_null, map_rekey, flat_map,
        generator_rows, generator_seek, generator_key_cardinality, generator_lag_bound, source_ranges, source_partition_rows,
        fnv_partition_assignment, partition_record_counts, fan_out_union, fan_out_branches, multi_input_merge, diamond_counts,
        keyed_count, keyed_sum_flush, watermark_running, merged_inputs_watermark, tumbling_count, tumbling_count_negative,
        late_by_watermark, exchange_placement, custom_source, table_sink, each_sink, unkeyed_rejected, stream_resume,
        stream_exactly_once, stream_graph, stream_keyed_state, stream_windows,
    )
}

ORACLES: dict[str, str] = {
    "identity_events": _BASE,
    "filter_event_time_mod3": f"{_BASE} where ({_MS}) % 3 = 0",
    "filter_drop_all": f"{_BASE} where false",
    "map_uppercase_value": f"select {_EVENT} as key, upper(event_type) as value, {_MS} as event_time from events",
    "map_drop_null": f"select key, value, event_time + 1 as event_time from ({_BASE}) where event_time % 2 = 0",
    "map_rekey": f"with e as ({_BASE}), {_fnv_of_mod()} select key, value, event_time, (h % 8)::int as partition from r8",
    "flat_map": f"select key, value, event_time + k as event_time from ({_BASE}) e, lateral (select unnest(range(e.event_time % 3)) as k)",
    "generator_rows": _generator_sql(WORKER, "select * from g"),
    "generator_seek": _generator_sql(WORKER, "select * from g", 15_000),
    "generator_key_cardinality": _generator_sql(WORKER, "select count(distinct key) as keys, count(*) as records from g"),
    "generator_lag_bound": _generator_sql(
        WORKER,
        f'select min({WORKER.base_event_time} + "offset" - event_time) as min_lag, max({WORKER.base_event_time} + "offset" - event_time) as max_lag from g',
    ),
    "source_ranges": _ranges_sql(),
    "source_partition_rows": f"""
select i::int as reader, (i * {WORKER.count}) // 8 as first_offset, ((i + 1) * {WORKER.count}) // 8 - (i * {WORKER.count}) // 8 as records
from range(8) r(i)""",
    "fnv_partition_assignment": f"with {_fnv_ctes()} select event_id, lpad(lower(hex(h::ubigint)), 16, '0') as hash, (h % 8)::bigint as partition from f8",
    "partition_record_counts": f"with {_fnv_ctes()} select (h % 8)::int as partition, count(*) as records from f8 group by 1",
    "fan_out_union": f"{_BASE} union all {_BASE}",
    "fan_out_branches": f"""
with e as ({_BASE})
select * from e where event_time % 2 = 0 union all select key, 'odd' as value, event_time from e where event_time % 2 = 1""",
    "multi_input_merge": f"""
select * from ({_generator_sql(WORKER, 'select key, value, event_time from g')})
union all
select * from ({_generator_sql(GeneratorConfig(**{**WORKER.__dict__, 'seed': 2}), 'select key, value, event_time from g')})""",
    "diamond_counts": f"select key, 2 * count(*) as records from ({_BASE}) group by key",
    "keyed_count": f"select key, count(*) as records, sum(strlen(value))::bigint as value_bytes from ({_BASE}) group by key",
    "keyed_sum_flush": f"select {_EVENT} as key, sum(round(value * 100)::bigint)::bigint as cents, max({_MS}) as last_event_time from events group by 1",
    "watermark_running": f"""
select event_id, {_MS} as event_time, max({_MS}) over (order by event_id rows unbounded preceding) - 500 as watermark from events""",
    "merged_inputs_watermark": f"""
select event_id, case when a is null or b is null or c is null then (-9223372036854775808)::bigint else least(a, b, c) - 500 end as watermark
from (select event_id, {", ".join(f"max(case when event_id % 3 = {k} then {_MS} end) over (order by event_id rows unbounded preceding) as {n}" for k, n in enumerate("abc"))} from events)""",
    "exchange_placement": f"""
with {_fnv_ctes()}
select {_EVENT} as key, props as value, {_MS} as event_time, (h % {PARTITIONS})::int as partition
from events join f8 using (event_id, user_id)""",
    "custom_source": "select lpad(lower(hex(n % 100)), 16, '0') as key, (n * n)::varchar as value, n as event_time from range(5000) r(n)",
    "table_sink": f"{_BASE} where ({_MS}) % 2 = 0",
    "each_sink": "select count(*) as written from events",
    "unkeyed_rejected": f"select count(*) > 0 as rejected from events where ({_MS}) % 10 = 0",
    "stream_resume": _generator_sql(STREAM, "select * from g"),
    "stream_exactly_once": _generator_sql(STREAM, "select * from g"),
    "stream_graph": _generator_sql(STREAM, "select key, value, case when event_time % 2 = 0 then event_time else -event_time end as event_time from g"),
    "stream_keyed_state": _generator_sql(STREAM, "select key, count(*) as last_count, count(*) as counts from g group by key"),
    "stream_windows": _generator_sql(
        STREAM,
        f"""select key, event_time // {SECOND} * {SECOND} as window_start, count(*) as records from g
group by 1, 2 having any_value(event_time // {SECOND} * {SECOND}) + {SECOND} <= (select max(event_time) from g) - {STREAM.max_lag}""",
    ),
    "tumbling_count": f"select key, event_time // {DAY} * {DAY} as window_start, count(*) as records from ({_BASE}) group by 1, 2",
    "tumbling_count_negative": f"""
select (floor((event_time - 1705000000000) / {DAY}.0) * {DAY})::bigint as window_start, count(*) as records from ({_BASE}) group by 1""",
    "late_by_watermark": _generator_sql(
        WORKER,
        """, w as (select "offset", event_time, max(event_time) over (order by "offset" rows unbounded preceding) - 250 as watermark from g)
select * from w where event_time < watermark""",
    ),
}
