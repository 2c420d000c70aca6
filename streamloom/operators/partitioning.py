"""Stable hash partitioning by key, merge and fan-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import fnv1a, long_of, mod_unsigned, wrapping


#: A column that holds the key's hash already, as sources with keys made from numbers give it.
HASH = "_key_hash"


class UnkeyedRecord(ValueError):
    """A record without a key has no partition."""


def partition_of(key: Column, partitions: int) -> Column:
    """FNV-1a of the key, unsigned, modulo ``partitions``; build inside ``wrapping``."""
    return mod_unsigned(fnv1a(key), partitions).cast("int")


def with_hash(df: DataFrame) -> DataFrame:
    """``df`` with the key's hash; in two steps, so that the key is decoded once."""
    if HASH in df.columns:
        return df
    with wrapping(df.sparkSession):
        numbered = df.withColumn("_key_number", long_of(F.col("key")))
        return numbered.withColumn(HASH, fnv1a(F.col("key"), F.col("_key_number"))).drop("_key_number")


def with_partition(df: DataFrame, partitions: int, name: str = "partition") -> DataFrame:
    with wrapping(df.sparkSession):
        return with_hash(df).withColumn(name, mod_unsigned(F.col(HASH), partitions).cast("int")).drop(HASH)


def exchange(df: DataFrame, partitions: int) -> DataFrame:
    """Each record in the partition with its number: placement that never changes between runs."""
    if partitions == 1:
        return df.drop(HASH).repartition(1)
    with wrapping(df.sparkSession):
        return with_hash(df).repartitionById(partitions, mod_unsigned(F.col(HASH), partitions).cast("int")).drop(HASH)


def merge(frames: list[DataFrame]) -> DataFrame:
    """All records of all inputs; a record that comes twice is there twice."""
    if not all(HASH in f.columns for f in frames):
        frames = [f.drop(HASH) for f in frames]
    return reduce(DataFrame.unionByName, frames)


def partition_counts(df: DataFrame, partitions: int) -> DataFrame:
    return with_partition(df, partitions).groupBy("partition").agg(F.count(F.lit(1)).alias("records"))


def empty_records(spark: SparkSession) -> DataFrame:
    from ..functions.records import SCHEMA

    return spark.createDataFrame([], SCHEMA)
