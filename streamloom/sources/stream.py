"""The generator as a streaming source whose offset is the record's position."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .generator import GeneratorConfig, slice_of, with_records

NAME = "streamloom_generator"
#: Offsets that are handed to Spark at a time.
BATCH = 1 << 16


class _Slice(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.start = int(options.get("start", 0))
        self.count = int(options["count"])
        self.step = int(options.get("rowsPerBatch", 1000))
        self.readers = int(options.get("parallelism", 1))
        self.fail_at = int(options.get("failAt", -1))
        self.at = None

    def initialOffset(self) -> dict:
        return {"offset": self.start}

    def latestOffset(self) -> dict:
        self.at = min(self.count, (self.start if self.at is None else self.at) + self.step)
        return {"offset": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        self.at = max(self.at or 0, end["offset"])
        n = end["offset"] - start["offset"]
        cuts = [slice_of(n, self.readers, i) for i in range(self.readers)]
        return [_Slice(start["offset"] + a, start["offset"] + b) for a, b in cuts]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        if partition.start <= self.fail_at < partition.end:
            raise RuntimeError(f"injected failure at offset {self.fail_at}")
        for at in range(partition.start, partition.end, BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(range(at, min(at + BATCH, partition.end)), pa.int64())], ["offset"])

    def commit(self, end: dict) -> None:
        pass


class OffsetSource(DataSource):
    """Offsets 0, 1, 2 ... as rows; records are columns over them."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "offset bigint"

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def generator_stream(spark: SparkSession, config: GeneratorConfig, rows_per_batch: int = 1000, parallelism: int = 1, fail_at: int = -1) -> DataFrame:
    """key, value, event_time, offset; resumes from a checkpoint at the position it had.

    ``fail_at`` makes the read of that offset fail, for recovery tests.
    """
    config.check()
    spark.dataSource.register(OffsetSource)
    options = {"count": config.count, "rowsPerBatch": rows_per_batch, "parallelism": parallelism, "failAt": fail_at}
    offsets = spark.readStream.format(NAME).options(**{k: str(v) for k, v in options.items()}).load()
    return with_records(spark, offsets, config)


def config_dict(config: GeneratorConfig) -> dict:
    return {f.name: asdict(config)[f.name] for f in fields(config)}
