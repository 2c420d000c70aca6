"""A corpus pipeline: rules, exact and near duplicates, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, whole
texts of any length; ``sf_dir`` isn't read.  All but the last return the
columns of ``docs`` unchanged, whatever others there are and however they are
named.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamloom.llm import exact_dedup, mixing, quality, sentencepiece_codec, simhash
from streamloom.llm.common import delete, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that no quality rule rejects; null and empty texts are rejected, repeated rows judged alike."""
    return quality.drop_low_quality(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space: the longest, then the smallest id, a null id last.

    Null and empty texts are equal; of rows that tie in all this one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of texts with a Jaccard similarity of 0.8 or more.

    Rows with a null id and texts without a word link to nothing and stay; of
    rows that share an id one stays.
    """
    return simhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as the mix takes them, up to twice each; a null source is a source, a null text has no words.

    Documents of one length are taken in the order of a seeded hash of their ids.
    """
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each row, repeated ones too; null and empty texts have none."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", source_mix),
    ("sentencepiece", token_ids),
]

#: The near-duplicate, mixing and encoding stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each is written as Parquet in the shared folder and read again.

    A stage's table goes once the next one's is written; the last one's reader
    is lazy, so what it reads stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            delete(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
