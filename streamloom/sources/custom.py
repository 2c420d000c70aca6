"""Sources that users write: one instance a partition, each reading its range."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..functions.records import SCHEMA, to_batch
from .generator import slice_of

BATCH = 4096


class Source:
    """What a source has to do.  ``seek_to(n)`` and reading equals reading from 0 and dropping n.

    A source that also has ``count()`` can be read by several readers.
    """

    def open(self) -> None: ...

    def next(self):
        """The next record, or None at the end, as often as it is asked."""
        raise NotImplementedError

    def seek_to(self, offset: int) -> None:
        raise NotImplementedError

    def position(self) -> int:
        raise NotImplementedError

    def close(self) -> None: ...


class UnsplittableSource(ValueError):
    """A source without a count, at a parallelism over 1."""


def read_range(source, parallelism: int, index: int) -> Iterator:
    """The records of one reader's range; a source that ends before it is no error."""
    source.open()
    try:
        left = None
        if hasattr(source, "count"):
            start, end = slice_of(source.count(), parallelism, index)
            source.seek_to(start)
            left = end - start
        while left is None or left > 0:
            record = source.next()
            if record is None:
                return
            yield record
            left = None if left is None else left - 1
    finally:
        source.close()


def source_records(spark: SparkSession, factory: Callable[[], object], parallelism: int = 1, name: str = "source") -> DataFrame:
    if parallelism > 1 and not hasattr(factory(), "count"):
        raise UnsplittableSource(f"vertex {name!r}: a source without count() can't be split {parallelism} ways")

    def each(batches) -> Iterator:
        for b in batches:
            for index in b.column(0).to_pylist():
                held = []
                for r in read_range(factory(), parallelism, index):
                    held.append(r)
                    if len(held) == BATCH:
                        yield to_batch(held)
                        held = []
                if held:
                    yield to_batch(held)

    return spark.range(0, parallelism, 1, parallelism).mapInArrow(each, SCHEMA)
