"""A deterministic, seekable source of records.

Record n is a function of the seed and n alone, so any range of offsets can
be made anywhere.  As a DataFrame it is ``spark.range`` and arithmetic that
stays in generated code; the ranges of its partitions are the same contiguous
slices a parallel reader takes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import GAMMA, MASK, MIX_A, MIX_B, big_endian, fnv1a_of_long, mix, mod_unsigned, wrapping
from ..functions.records import Record
from ..operators.partitioning import HASH

# What the seed is XORed with for each field.
KEY_SALT, VALUE_SALT, TIME_SALT = 1, 2, 3


@dataclass(frozen=True)
class GeneratorConfig:
    seed: int = 0
    count: int = 0
    key_cardinality: int = 0
    base_event_time: int = 0
    event_time_step: int = 0
    max_lag: int = 0
    value_size: int = 0

    def check(self) -> None:
        for name, least in (("count", 1), ("key_cardinality", 1), ("max_lag", 0), ("value_size", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"generator: {name} must be at least {least}, not {getattr(self, name)}")


def _mix(seed: int, n: int) -> int:
    z = (seed + (n + 1) * GAMMA) & MASK
    z = ((z ^ z >> 30) * MIX_A) & MASK
    z = ((z ^ z >> 27) * MIX_B) & MASK
    return z ^ z >> 31


def record_at(c: GeneratorConfig, n: int) -> Record:
    base, words = _mix(c.seed ^ VALUE_SALT, n), -(-c.value_size // 8)
    return Record(
        (_mix(c.seed ^ KEY_SALT, n) % c.key_cardinality).to_bytes(8, "big"),
        b"".join(_mix(base, i).to_bytes(8, "big") for i in range(words))[: c.value_size],
        c.base_event_time + n * c.event_time_step - _mix(c.seed ^ TIME_SALT, n) % (c.max_lag + 1),
    )


def slice_of(count: int, parallelism: int, index: int) -> tuple[int, int]:
    """The offsets [start, end) that reader ``index`` of ``parallelism`` takes."""
    return index * count // parallelism, (index + 1) * count // parallelism


def key_number(c: GeneratorConfig, n: Column) -> Column:
    return mod_unsigned(mix(c.seed ^ KEY_SALT, n), c.key_cardinality)


def event_time(c: GeneratorConfig, n: Column) -> Column:
    return F.lit(c.base_event_time) + n * c.event_time_step - mod_unsigned(mix(c.seed ^ TIME_SALT, n), c.max_lag + 1)


def value_bytes(c: GeneratorConfig, base: Column) -> Column:
    words = [big_endian(mix(base, F.lit(i).cast("bigint"))) for i in range(-(-c.value_size // 8))]
    return F.substring(F.concat(*words), 1, c.value_size) if words else F.lit(b"")


def with_records(spark: SparkSession, offsets: DataFrame, c: GeneratorConfig, offset: str = "offset", hashed: bool = False) -> DataFrame:
    """key, value, event_time and the offset for a frame of offsets, batch or streaming; with ``hashed`` the key's hash too."""
    with wrapping(spark):
        n = F.col(offset)
        based = offsets.withColumns({"_base": mix(c.seed ^ VALUE_SALT, n), "_key": key_number(c, n)})
        return based.select(
            big_endian(F.col("_key")).alias("key"),
            value_bytes(c, F.col("_base")).alias("value"),
            event_time(c, n).alias("event_time"),
            n.alias("offset"),
            *([fnv1a_of_long(F.col("_key")).alias(HASH)] if hashed else []),
        )


class Generator:
    """The source itself: read record by record, or as a DataFrame."""

    def __init__(self, config: GeneratorConfig):
        self.config = config
        self._at = 0

    def open(self) -> None:
        self.config.check()

    def next(self) -> Record | None:
        if self._at >= self.config.count:
            return None
        self._at += 1
        return record_at(self.config, self._at - 1)

    def seek_to(self, offset: int) -> None:
        if offset < 0:
            raise ValueError(f"generator: cannot seek to {offset}")
        self._at = offset

    def position(self) -> int:
        return self._at

    def count(self) -> int:
        return self.config.count

    def close(self) -> None:
        pass

    def dataframe(self, spark: SparkSession, parallelism: int | None = None, offset: int = 0, with_offset: bool = False, hashed: bool = False) -> DataFrame:
        """The records from ``offset`` on; partition i holds slice i of them."""
        self.config.check()
        if offset < 0:
            raise ValueError(f"generator: cannot seek to {offset}")
        start = min(offset, self.config.count)
        ids = spark.range(start, self.config.count, 1, parallelism).withColumnRenamed("id", "offset")
        out = with_records(spark, ids, self.config, hashed=hashed)
        return out if with_offset else out.drop("offset")
