"""The record: a key, a value and an event time in milliseconds."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import big_endian

SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("event_time", T.LongType()),
    ]
)
ARROW = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("event_time", pa.int64())])
COLUMNS = tuple(SCHEMA.names)


class Record(NamedTuple):
    key: bytes
    value: bytes
    event_time: int


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def to_batch(records: list) -> pa.RecordBatch:
    columns = list(zip(*records)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def from_batch(batch: pa.RecordBatch):
    return map(Record, *(batch.column(c).to_pylist() for c in COLUMNS))


def records(df: DataFrame, key: Column, value: Column, event_time: Column) -> DataFrame:
    """Any table as records.  An integer key becomes its 8 big-endian bytes."""
    kinds = dict(df.select(key.alias("k")).dtypes)
    key = big_endian(key.cast("bigint")) if kinds["k"] in ("bigint", "int", "smallint", "tinyint") else key.cast("binary")
    return df.select(key.alias("key"), value.cast("binary").alias("value"), event_time.cast("bigint").alias("event_time"))


def event_records(events: DataFrame) -> DataFrame:
    return records(events, F.col("user_id"), F.col("props"), millis(F.col("ts")))


def printable(df: DataFrame, *more: str) -> DataFrame:
    """Records with the key in hex and the value as text."""
    return df.select(F.lower(F.hex("key")).alias("key"), F.col("value").cast("string").alias("value"), "event_time", *more)


def unkeyed(key: Column | None = None) -> Column:
    """A null key and an empty one are the same: no key."""
    key = F.col("key") if key is None else key
    return key.isNull() | (F.octet_length(key) == 0)


ArrowMap = Callable[..., object]
