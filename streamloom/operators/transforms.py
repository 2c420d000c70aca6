"""Map, Filter and operators that users write.

Expressions come first: a Map or Filter given as columns is a projection or
a predicate that Catalyst fuses and pushes down.  Python functions run over
Arrow batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import wrapping
from ..functions.records import COLUMNS, SCHEMA, Record, from_batch, to_batch
from .partitioning import HASH, partition_of

#: The watermark before there is one.
NO_WATERMARK = -(2**63)


class Transform:
    """What stands at an operator vertex: records in, records out."""

    #: whether records may leave with another key than they came with
    changes_key = False
    #: whether each key has to meet one instance
    keyed = False

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class Map(Transform):
    """One record to one record or none.

    Give columns for what changes and ``keep`` for what stays (null drops),
    or a function from a record to a record or None.  An error in the
    function fails the job.
    """

    def __init__(self, function: Callable[[Record], Record | None] | None = None, *, key: Column | None = None, value: Column | None = None, event_time: Column | None = None, keep: Column | None = None):
        self.function = function
        self.columns = {"key": key, "value": value, "event_time": event_time}
        self.keep = keep
        self.changes_key = function is not None or key is not None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.function is not None:
            function = self.function

            def each(batches):
                for b in batches:
                    out = [x for x in map(function, from_batch(b)) if x is not None]
                    if out:
                        yield to_batch(out)

            return df.select(*COLUMNS).mapInArrow(each, SCHEMA)
        if self.keep is not None:
            df = df.filter(F.coalesce(self.keep, F.lit(False)))
        kinds = dict(zip(COLUMNS, ("binary", "binary", "bigint")))
        return df.select(*[F.col(c) if x is None else x.cast(kinds[c]).alias(c) for c, x in self.columns.items()])


class Identity(Map):
    def __init__(self):
        super().__init__()

    def apply(self, df: DataFrame) -> DataFrame:
        return df


class Filter(Transform):
    """Keeps the records a predicate holds for; null is false."""

    def __init__(self, predicate: Column | Callable[[Record], bool]):
        self.predicate = predicate

    def apply(self, df: DataFrame) -> DataFrame:
        if isinstance(self.predicate, Column):
            return df.filter(F.coalesce(self.predicate, F.lit(False)))
        predicate = self.predicate

        def each(batches):
            for b in batches:
                out = [r for r in from_batch(b) if predicate(r)]
                if out:
                    yield to_batch(out)

        return df.select(*COLUMNS).mapInArrow(each, SCHEMA)


class FlatMap(Transform):
    """One record to any number of records, as an array of (key, value, event_time) structs."""

    changes_key = True

    def __init__(self, records: Column):
        self.records = records

    def apply(self, df: DataFrame) -> DataFrame:
        made = df.select(F.explode(self.records).alias("r"))
        return made.select(F.col("r.key").cast("binary").alias("key"), F.col("r.value").cast("binary").alias("value"), F.col("r.event_time").cast("bigint").alias("event_time"))


class Operator:
    """The full operator contract for ``Custom``: state may live in the instance.

    Each partition has its own instance, and all records of a key come to the
    same one.  In a bounded run what ``end_of_stream`` returns is emitted
    last, and there is no watermark.  In a stream there is no end;
    ``process_watermark`` is called whenever the watermark has risen, after
    the records before it, and what ``snapshot`` gives after each batch is
    kept in the state store and given to ``restore`` of the instance that goes
    on, also in another run.
    """

    #: The watermark that holds now; it never falls.
    current_watermark = NO_WATERMARK

    def open(self) -> None: ...

    def process(self, record: Record) -> Iterable[Record]:
        raise NotImplementedError

    def process_watermark(self, watermark: int) -> Iterable[Record]:
        return ()

    def end_of_stream(self) -> Iterable[Record]:
        return ()

    def snapshot(self) -> bytes:
        """What the instance holds besides the watermark."""
        return pickle.dumps({k: v for k, v in self.__dict__.items() if k != "current_watermark"})

    def restore(self, data: bytes) -> None:
        self.__dict__.update(pickle.loads(data))

    def close(self) -> None: ...


class Custom(Transform):
    """``factory`` makes the operator's instances; on streams ``lag`` ms behind the event times is the watermark."""

    changes_key = True
    keyed = True

    def __init__(self, factory: Callable[[], Operator], lag: int | None = None):
        self.factory, self.lag = factory, lag

    def apply(self, df: DataFrame) -> DataFrame:
        factory = self.factory

        def each(batches):
            op = factory()
            op.open()
            try:
                for b in batches:
                    out = [x for r in from_batch(b) for x in op.process(r)]
                    if out:
                        yield to_batch(out)
                last = list(op.end_of_stream())
                if last:
                    yield to_batch(last)
            finally:
                op.close()

        return df.select(*COLUMNS).mapInArrow(each, SCHEMA)

    def apply_stream(self, df: DataFrame, partitions: int) -> DataFrame:
        """The operator over a stream: a group of the state store is a partition, its state the instance's snapshot."""
        from ..streaming.event_time import with_watermark

        factory, timed = self.factory, self.lag is not None
        if timed:
            df = with_watermark(df, self.lag)
        with wrapping(df.sparkSession):
            df = df.drop(HASH).withColumn("part", partition_of(F.col("key"), partitions))

        def each(part, frames, state):
            op = factory()
            op.open()
            try:
                seen = NO_WATERMARK
                if state.exists:
                    seen, held = state.get
                    op.restore(bytes(held))
                now = state.getCurrentWatermarkMs() if timed else NO_WATERMARK
                # Spark's watermark is 1970 until there is one
                op.current_watermark = now = max(now if now > 0 else NO_WATERMARK, seen)
                out: list[Record] = []
                if not state.hasTimedOut:
                    for f in frames:
                        for k, v, t in zip(f["key"], f["value"], f["event_time"]):
                            out += op.process(Record(bytes(k), bytes(v or b""), int(t)))
                if now > seen:
                    out += op.process_watermark(now)
                state.update((now, op.snapshot()))
                if timed:
                    # called again, without records, as soon as the watermark rises
                    state.setTimeoutTimestamp(max(now, 0) + 1)
            finally:
                op.close()
            yield pd.DataFrame(out, columns=list(COLUMNS)).astype({"event_time": "int64"})

        keep = "EventTimeTimeout" if timed else "NoTimeout"
        return df.groupBy("part").applyInPandasWithState(each, SCHEMA, "watermark long, held binary", "append", keep)
