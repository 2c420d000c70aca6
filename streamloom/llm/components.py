"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = checkpointed(e.groupBy("u").agg(F.min("v").alias("m")))
    moved = e.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of ``links`` (a, b) that isn't its component's smallest.

    Rounds go on until one changes nothing; each is checkpointed.  Nothing
    but a count and a checksum comes to the driver.  Minima are taken, with
    map-side combine, and written before rows are joined to them: such a join
    has exchanges of its own on both sides, so adaptive execution can split a
    node of very many links.
    """
    e = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpointed(e)
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    before = mark(e)
    while before[0]:
        e = checkpointed(_small_star(_large_star(e)))
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
