"""Streaming runs that end, resume and write each record once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def to_the_end(writer: DataStreamWriter) -> StreamingQuery:
    """Runs batch after batch until the source has no more.

    A source that limits its batches itself would run just one with
    ``availableNow``.
    """
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what there is to Parquet and stops; a later call goes on where this one ended.

    The file sink's log names the files of each batch, so a batch that is
    written again after a failure replaces its first try.
    """
    to_the_end(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode))


def run_by_batch(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Exactly once through ``foreachBatch``: a batch owns the folder of its id and overwrites it."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    to_the_end(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def run_complete(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """All groups of an aggregation, also those that a watermark would hold back."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode("complete")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    to_the_end(writer)
    return stream.sparkSession.table(name)
