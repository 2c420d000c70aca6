"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every text contract: space and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"
CHECKPOINT_CONF = "spark.checkpoint.dir"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the context's checkpoint directory, else ``spark.checkpoint.dir``.

    Where neither is set a local session (tests) gets a temporary folder; on
    a cluster there is none that could be guessed, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
        if not named and sc.master.partition("[")[0] != "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="streamloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once a row.

    A plain column reference inside a lambda may be replaced by its whole
    expression when projections are merged, and then runs for each element;
    a lambda variable can't be.
    """
    return F.transform(F.array(value), body)[0]


def strip_white(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    """The runs ``[^\\x20\\x09-\\x0D]+`` of ``text``, in order."""
    for c in WHITE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def prefix_sums(a: Column, block: int = 256) -> Column:
    """For each element of the int array ``a``, the sum of those before it.

    Works by blocks, so the cost stays close to linear on very long arrays.
    """

    def within(base: Column, part: Column) -> Column:
        start = F.struct(base.alias("s"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, e: F.struct((acc["s"] + e).alias("s"), F.array_append(acc["out"], acc["s"]).alias("out"))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    def over(v: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")),
            lambda b: F.slice(v, b * block + 1, block),
        )
        return let(
            parts,
            lambda p: let(
                F.transform(p, total),
                lambda sums: F.flatten(
                    F.transform(p, lambda x, b: within(F.when(b > 0, total(F.slice(sums, F.lit(1), b))).otherwise(0), x))
                ),
            ),
        )

    return let(a, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(F.array().cast("array<int>")))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.parquet(path)
    table.written_to = path
    return table


def delete(table: DataFrame) -> None:
    """Removes the table that :func:`written` made; nothing may read it any more."""
    sc = table.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(table.written_to)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """:func:`written` for tables that nothing reads after the block; they are deleted then."""
    made: list[DataFrame] = []

    def write(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    try:
        yield write
    finally:
        for df in made:
            delete(df)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries within remove their shuffle files when they end, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Actions within hand Python at most ``size`` of rows at a time, so that large rows don't pile up."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)
