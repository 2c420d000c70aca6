import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.functions.bits import fnv1a, mix, mod_unsigned, signed, u64, wrapping
from streamloom.operators.partitioning import exchange, partition_counts, with_partition
from streamloom.sources.custom import UnsplittableSource, read_range, source_records
from streamloom.sources.generator import Generator, GeneratorConfig, record_at, slice_of

RUNTIME = GeneratorConfig(7, 1000, 16, 1700000000000, 10, 50, 8)
WORKER = GeneratorConfig(1, 100, 1000, 1704067200000, 1, 500, 16)
PLAIN = GeneratorConfig(1, 10000, 64, 1700000000000, 10, 250, 20)


def rows(df):
    return sorted((bytes(r["key"]), bytes(r["value"]), r["event_time"]) for r in df.collect())


@pytest.mark.parametrize(
    "config, n, key, value, time",
    [
        (RUNTIME, 0, "0000000000000000", "fad6e24671254235", 1699999999990),
        (RUNTIME, 2, "0000000000000006", "57bb9081b9ada060", 1700000000017),
        (WORKER, 0, "0000000000000217", "bccdfd9c96a1889797e4a26fa4bd44f2", 1704067199735),
        (WORKER, 2, "00000000000002a7", "7446feafe645ba44d710bab11d8c2704", 1704067199591),
        (PLAIN, 1, "0000000000000034", "5d90d27a47a435e570912ca8423f754d0d0c0a04", 1699999999836),
    ],
)
def test_golden_records(spark, config, n, key, value, time):
    r = record_at(config, n)
    assert (r.key.hex(), r.value.hex(), r.event_time) == (key, value, time)
    got = Generator(config).dataframe(spark, 2, offset=n).limit(1).collect()[0]
    assert (bytes(got["key"]).hex(), bytes(got["value"]).hex(), got["event_time"]) == (key, value, time)


@pytest.mark.parametrize("seed", [0, 1, 0xDEADBEEF, 0x9E3779B97F4A7C15])
def test_frame_equals_reading(spark, seed):
    c = GeneratorConfig(seed, 500, 64, 1700000000000, 10, 250, 20)
    g = Generator(c)
    g.open()
    read = []
    while (r := g.next()) is not None:
        read.append(tuple(r))
    assert g.next() is None and g.position() == 500
    assert rows(g.dataframe(spark, 3)) == sorted(read)
    lags = [c.base_event_time + n * 10 - r[2] for n, r in enumerate(read)]
    assert min(lags) >= 0 and max(lags) <= 250 and len({r[0] for r in read}) == 64


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 17])
def test_value_sizes(spark, size):
    c = GeneratorConfig(3, 20, 4, 0, -5, 0, size)
    assert rows(Generator(c).dataframe(spark)) == sorted(tuple(record_at(c, n)) for n in range(20))


def test_seek(spark):
    g = Generator(RUNTIME)
    g.seek_to(990)
    assert [g.next() for _ in range(12)] == [record_at(RUNTIME, n) for n in range(990, 1000)] + [None, None]
    with pytest.raises(ValueError):
        g.seek_to(-1)
    assert g.position() == 1000
    g.seek_to(5000)
    assert g.next() is None
    assert Generator(RUNTIME).dataframe(spark, offset=5000).count() == 0
    with pytest.raises(ValueError):
        Generator(RUNTIME).dataframe(spark, offset=-1)


@pytest.mark.parametrize("change", [{"count": 0}, {"key_cardinality": 0}, {"max_lag": -1}, {"value_size": -1}])
def test_bad_configs(change):
    with pytest.raises(ValueError, match=next(iter(change))):
        Generator(GeneratorConfig(**{**RUNTIME.__dict__, **change})).open()


def test_slices(spark):
    of = lambda n, p: [slice_of(n, p, i) for i in range(p)]
    assert of(10, 4) == [(0, 2), (2, 5), (5, 7), (7, 10)]
    assert of(3, 8) == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 2), (2, 2), (2, 3)]
    c = GeneratorConfig(**{**RUNTIME.__dict__, "count": 10})
    parts = Generator(c).dataframe(spark, 4, with_offset=True).select(F.spark_partition_id().alias("p"), "offset").collect()
    assert sorted((r["p"], r["offset"]) for r in parts) == [(i, n) for i, (a, z) in enumerate(of(10, 4)) for n in range(a, z)]


def test_bits(spark):
    with wrapping(spark):
        df = spark.createDataFrame([(b"",), (b"a",), (b"foobar",), ((1).to_bytes(8, "big"),)], "k binary").select(F.hex(fnv1a(F.col("k"))).alias("h"))
    assert [r["h"].lower() for r in df.collect()] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8", "a8c7f732281a3812"]
    big = [0, 1, 2**63 - 1, 2**63, 2**64 - 1, 0x9E3779B97F4A7C15]
    df = spark.createDataFrame([(signed(x),) for x in big], "h long").select(*[mod_unsigned(F.col("h"), m).alias(f"m{m}") for m in (1, 3, 8, 1000)])
    assert [tuple(r) for r in df.collect()] == [tuple(x % m for m in (1, 3, 8, 1000)) for x in big]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    with wrapping(spark):
        assert spark.range(1).select(mix(u64(5), F.col("id"))).count() == 1


@pytest.mark.parametrize("p", [1, 2, 4, 8])
def test_exchange_places_by_hash(spark, p):
    df = with_partition(Generator(RUNTIME).dataframe(spark, 3), p)
    out = exchange(df, p).withColumn("at", F.spark_partition_id())
    assert out.filter("at != partition").count() == 0 and out.count() == 1000
    assert out.rdd.getNumPartitions() == p


def test_spread(spark):
    c = GeneratorConfig(**{**RUNTIME.__dict__, "count": 50_000, "key_cardinality": 10**9})
    n = [r["records"] for r in partition_counts(Generator(c).dataframe(spark, 4), 8).collect()]
    assert len(n) == 8 and max(np.abs(np.array(n) / (50_000 / 8) - 1)) < 0.1


class Countless:
    def __init__(self, n=20, closed=None):
        self.n, self.at, self.closed = n, 0, closed

    def open(self): ...

    def next(self):
        self.at += 1
        return (b"k", bytes([self.at]), self.at) if self.at <= self.n else None

    def seek_to(self, offset):
        self.at = offset

    def position(self):
        return self.at

    def close(self):
        if self.closed is not None:
            self.closed.append(1)


def test_custom_sources(spark):
    assert source_records(spark, Countless).count() == 20
    with pytest.raises(UnsplittableSource, match="'s'.*count"):
        source_records(spark, Countless, 2, "s")
    for p in (1, 2, 4, 8):
        assert rows(source_records(spark, lambda: Generator(RUNTIME), p)) == rows(Generator(RUNTIME).dataframe(spark))
    closed = []
    assert len(list(read_range(Countless(3, closed), 1, 0))) == 3 and closed == [1]
