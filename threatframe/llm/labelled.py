"""Bounded samples of labelled rows for the classifiers, and the split that the queries fix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatframe.llm.common import staged

SEED = 11
SAMPLE_BYTES = 16 << 20  #: text bytes of a fitting sample, at most
LONGEST = 256 << 10  #: bytes of a text of a fitting sample, at most


def remainder(modulus: int):
    """crc32(doc_id as text) modulo modulus; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def sample(labels: DataFrame, label: str, rows: int, modulus: int, held: int, seed: int = SEED) -> DataFrame:
    """At most `rows` labelled (doc_id, label, at) outside the held-out part, the first in a seeded hash order `at`."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(remainder(modulus) != held)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    return known.withColumn("at", F.xxhash64(F.lit(seed), "doc_id")).orderBy("at", "doc_id").limit(rows)


def fitting_texts(docs: DataFrame, picked: DataFrame, most: int = SAMPLE_BYTES, longest: int = LONGEST) -> tuple[list[str], list[int]]:
    """(texts, labels) of the picked ids on the driver, in the order of the sample.

    Bounded in rows (by `picked`, which is therefore broadcast) and in bytes: one text per doc_id (the least of several),
    none over `longest` bytes, and as many in order as `most` bytes hold. Null texts count as empty.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.filter(F.octet_length("text") <= longest).join(F.broadcast(picked), "doc_id")
    found = staged(found.groupBy("doc_id", "label", "at").agg(F.min("text").alias("text")), "sample")
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy("at", "doc_id"))
    used = found.select("doc_id", "at", so_far.alias("so_far")).filter(F.col("so_far") <= most).select("doc_id")
    got = found.join(F.broadcast(used), "doc_id").orderBy("at", "doc_id").select("text", "label").collect()
    return [r.text for r in got], [r.label for r in got]
