"""Corpus pipeline: quality rules, exact dedup, near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of `documents`. The mix repeats a document that it takes twice. The rounding draws of the mix have no SQL
form, so ORACLE_SQL is None and the tests hold run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threatframe.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from threatframe.llm.common import read, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; repeated rows are judged alike, very
    long texts whole; other columns, whatever their names, stay as they are. No rows give no rows."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id, a null id only where the group has no other;
    of rows that repeat that id, one. Null counts as empty. No rows give no rows."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least doc_id; of rows that repeat it, one. Texts without words
    are one class. No rows give no rows."""
    return near_dedup.keep_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them. A null source is one of its own, texts without words are
    never taken, repeated rows are drawn each for itself. No rows give no rows."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 tokens and their places in sequences; a null text is a document of the closing id alone, a very
    long one is cut, repeated rows are packed each for itself. Other columns are left out. No rows give no rows."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again, on the whole documents table."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
