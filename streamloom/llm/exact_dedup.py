"""Exact deduplication by a 128-bit content hash.

Texts are equal when they are identical without their white space.  Rows are
grouped by the hash *and* the normalised bytes, so two texts that share a
hash stay apart; the aggregate compares key bytes itself.  It combines on the
map side, so a group of copies sends one row a task however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import strip_white

_SPAN = 20 * 10**18  # over the range of 2**63 - id, which is at most 2**64


def _rank(length: Column, doc_id: Column) -> Column:
    """Larger is better: most code points, then the smallest id, null last.

    One fixed-width number, so that the aggregate stays a hash aggregate.
    """
    by_id = F.lit(str(2**63)).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)")
    return (
        length.cast("decimal(11,0)") * F.lit(str(_SPAN)).cast("decimal(20,0)")
        + F.coalesce(by_id, F.lit(0).cast("decimal(21,0)"))
    ).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    by_id = rank % F.lit(str(_SPAN)).cast("decimal(38,0)")
    return F.when(by_id != 0, (F.lit(str(2**63)).cast("decimal(38,0)") - by_id).cast("bigint"))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        strip_white(text).alias("_norm"),
        F.char_length(text).alias("_len"),
    )
    return base.select(
        "doc_id",
        "_norm",
        _rank(F.col("_len"), F.col("doc_id")).alias("_rank"),
        F.unhex(F.md5(F.col("_norm").cast("binary"))).alias("_h128"),
        F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)).alias("_sha"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal.  Of a group the row with the most code
    points in its original text stays, then the smallest id; a null id comes
    last.  Rows repeated with the same id and length tie and are all ``kept``
    here, as they are one document; :func:`drop_exact_duplicates` leaves one.
    Ids are integers.  Other columns of ``docs`` are not read.
    """
    hashed = _hashed(docs, id_col, text_col)
    groups = (
        hashed.groupBy("_h128", "_sha", "_norm")
        .agg(F.max("_rank").alias("_best"), F.count(F.lit(1)).alias("group_size"))
        .drop("_norm")
    )
    return hashed.drop("_norm").join(groups, ["_h128", "_sha"]).select(
        "doc_id",
        _id_of(F.col("_best")).alias("keep_id"),
        "group_size",
        (F.col("_rank") == F.col("_best")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row left of each group of equal texts, columns unchanged.

    Rows that tie (same id and text) are reduced to one.  A null text equals
    an empty one.  Extra columns keep their names, whatever they are.
    """

    def key(doc_id: Column, sha: Column) -> Column:
        return F.concat_ws("|", F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("")), sha)

    report = exact_duplicates(docs, id_col, text_col)
    stay = report.filter("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("_loom_key"))
    sha = F.sha2(strip_white(F.coalesce(docs[text_col], F.lit(""))).cast("binary"), 256)
    # the most code points first: a row that only shares id and normal form with the one that stays goes
    rank = F.row_number().over(Window.partitionBy("_loom_key").orderBy(F.col("_loom_len").desc()))
    return (
        docs.withColumns({"_loom_key": key(docs[id_col], sha), "_loom_len": F.char_length(F.coalesce(docs[text_col], F.lit("")))})
        .join(stay, "_loom_key", "left_semi")
        .withColumn("_loom_r", rank)
        .filter("_loom_r = 1")
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
