"""Where records end: in memory, nowhere, in a table, or in a sink that users write."""

from __future__ import annotations

import threading
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.records import COLUMNS, Record, from_batch


class Sink:
    def write_all(self, df: DataFrame) -> None:
        raise NotImplementedError

    def write_batch(self, df: DataFrame, batch: int) -> None:
        """A batch of a stream; after a failure the same batch comes again."""
        self.write_all(df)


class Collect(Sink):
    """Records in the driver's memory, for results that fit there."""

    def __init__(self):
        self._held: list[Record] = []
        self._batches: set[int] = set()
        self._lock = threading.Lock()

    def write_all(self, df: DataFrame) -> None:
        rows = df.select(*COLUMNS).collect()
        with self._lock:
            self._held += [Record(bytes(r[0] or b""), bytes(r[1] or b""), r[2]) for r in rows]

    def write_batch(self, df: DataFrame, batch: int) -> None:
        if batch not in self._batches:
            self.write_all(df)
            self._batches.add(batch)

    def records(self) -> list[Record]:
        """A copy, which later writes don't change."""
        with self._lock:
            return list(self._held)


class Discard(Sink):
    """Makes every record and keeps none."""

    def write_all(self, df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()


class Table(Sink):
    """A Parquet folder; a batch of a stream owns the folder of its id in it, so each record is there once."""

    def __init__(self, path: str, mode: str = "errorifexists"):
        self.path, self.mode = path, mode

    def write_all(self, df: DataFrame) -> None:
        df.write.mode(self.mode).parquet(self.path)

    def write_batch(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


class Writer:
    """A sink's contract for ``Each``: one instance a partition, closed on success and failure alike."""

    def open(self) -> None: ...

    def write(self, record: Record) -> None:
        raise NotImplementedError

    def close(self) -> None: ...


class Each(Sink):
    """A writer for each partition.

    A task that is tried again, or that runs twice by speculation, writes its
    records again; a writer that needs each once has to tell tries apart, for
    instance by ``TaskContext`` and a key of its own.  ``written`` counts the
    tries that Spark kept.
    """

    def __init__(self, factory: Callable[[], Writer]):
        self.factory = factory
        self.written = 0

    def write_all(self, df: DataFrame) -> None:
        factory = self.factory

        def each(batches):
            writer, n = factory(), 0
            writer.open()
            try:
                for b in batches:
                    for r in from_batch(b):
                        writer.write(r)
                        n += 1
            finally:
                writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        counts = df.select(*COLUMNS).mapInArrow(each, "n long")
        self.written += counts.groupBy().sum("n").collect()[0][0] or 0
