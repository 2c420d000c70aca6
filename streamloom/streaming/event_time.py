"""Event time over streams and tables: watermarks, late records, tumbling windows.

Times are in milliseconds and may lie before 1970 in tables.  A stream's
watermark starts at 1970 and would drop such records, so streams refuse them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_start(event_time: Column, size: int) -> Column:
    """The start of the tumbling window; floors, also below zero."""
    return event_time - F.pmod(event_time, F.lit(size))


def tumbling_counts(df: DataFrame, size: int) -> DataFrame:
    """key, window_start, records: a batch, so every window is complete at its end."""
    return df.groupBy("key", window_start(F.col("event_time"), size).alias("window_start")).agg(F.count(F.lit(1)).alias("records"))


def _running_max(df: DataFrame, values: list[str], order: Column, width: int) -> DataFrame:
    """``values`` as their maxima so far, in the order of the integer ``order`` over the whole table.

    No task gets all of it: ranges of ``width`` numbers are scanned on their
    own, then ranges of ranges, and what came before each is joined to it.
    """
    upto = Window.unboundedPreceding
    ranged = df.withColumn("_order", order.cast("bigint")).withColumn("_part", F.floor(F.col("_order") / width))
    within = Window.partitionBy("_part").orderBy("_order").rowsBetween(upto, 0)
    tops = ranged.groupBy("_part").agg(*[F.max(v).alias(v) for v in values]).withColumn("_block", F.floor(F.col("_part") / width))
    # one row for 65,536 ranges goes through one task
    blocks = tops.groupBy("_block").agg(*[F.max(v).alias(v) for v in values])
    above = blocks.select("_block", *[F.max(v).over(Window.orderBy("_block").rowsBetween(upto, -1)).alias(f"_above_{v}") for v in values])
    own = Window.partitionBy("_block").orderBy("_part").rowsBetween(upto, -1)
    held = tops.join(above, "_block").select("_part", *[F.greatest(F.max(v).over(own), f"_above_{v}").alias(f"_before_{v}") for v in values])
    scanned = ranged.withColumns({f"_so_far_{v}": F.max(v).over(within) for v in values}).join(held, "_part")
    out = scanned.withColumns({v: F.greatest(f"_so_far_{v}", f"_before_{v}") for v in values})
    return out.drop("_order", "_part", *[f"_so_far_{v}" for v in values], *[f"_before_{v}" for v in values])


def running_watermark(df: DataFrame, order: Column, lag: int, width: int = 1 << 16) -> DataFrame:
    """``watermark`` after each row: the largest event time so far less ``lag``; ``order`` is an integer, such as an offset."""
    return _running_max(df.withColumn("watermark", F.col("event_time") - lag), ["watermark"], order, width)


def merged_watermark(df: DataFrame, order: Column, lag: int, source: Column, sources: int, width: int = 1 << 16) -> DataFrame:
    """``watermark`` after each row of a merge: the least of the watermarks of its inputs.

    ``source`` numbers the input of each row from 0.  Until each input has had
    a row the watermark is the least BIGINT.
    """
    names = [f"_of_{k}" for k in range(sources)]
    own = {x: F.when(source == k, F.col("event_time") - lag) for k, x in enumerate(names)}
    out = _running_max(df.withColumns(own), names, order, width)
    every = F.coalesce(*[F.when(F.col(x).isNull(), F.lit(True)) for x in names], F.lit(False))
    least = F.least(*names) if sources > 1 else F.col(names[0])
    return out.withColumn("watermark", F.when(~every, least).otherwise(F.lit(-(2**63)).cast("bigint"))).drop(*names)


def late(df: DataFrame, order: Column, lag: int) -> DataFrame:
    """The rows whose event time is below the watermark that held before them."""
    return running_watermark(df, order, lag).filter(F.col("event_time") < F.col("watermark"))


def with_watermark(stream: DataFrame, lag: int) -> DataFrame:
    """A stream of records with ``event_ts`` and a watermark ``lag`` ms behind it."""
    checked = F.when(F.col("event_time") >= 0, F.col("event_time")).otherwise(
        F.raise_error(F.lit("event times before 1970 can't be streamed: the watermark starts there")).cast("bigint")
    )
    return stream.withColumn("event_ts", F.timestamp_millis(checked)).withWatermark("event_ts", f"{lag} milliseconds")


def windowed_stream(stream: DataFrame, size: int, lag: int) -> DataFrame:
    """The streaming form of :func:`tumbling_counts`.

    In append mode a window comes out once the watermark has passed its end;
    windows still open at the end of a bounded run stay in the state, so use
    complete mode or the batch form where those are wanted.
    """
    w = F.window("event_ts", f"{size} milliseconds")
    counted = with_watermark(stream, lag).groupBy("key", w.alias("w")).agg(F.count(F.lit(1)).alias("records"))
    return counted.select("key", F.unix_millis("w.start").alias("window_start"), "records")


def keyed_counts(df: DataFrame) -> DataFrame:
    """What an operator that counts by key emits at the end of its stream."""
    return df.groupBy("key").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("value")).alias("value_bytes"))
