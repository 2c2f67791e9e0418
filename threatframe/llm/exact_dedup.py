"""Operator 1: exact dedup through a cuckoo-filter index of live digests.

Two texts are equal when they agree after lower-casing A-Z (a null text counts as empty). Of equal texts the
row with the largest doc_id stays (a null doc_id counts as smaller than any other; rows that tie on doc_id keep
one of them, by place in the input).

Plan: one pass over the texts writes (doc_id, digest, part) with the input partition's number as `part`. Partial
groups (digest, part) are dealt out by digest; each task folds its rows into a cuckoo filter whose hits are
verified against the digests kept in the hit bucket, and returns the group's facts for every (digest, part). The
documents then join on (digest, part), so a group that holds a third of all rows is spread like the input is.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatframe.llm.common import raw_text, read, released, slices, small_batches, staged, unnamed

SLOTS = 4  #: entries of a bucket
MAX_KICKS = 200  #: moves after which an insertion counts as an overflow
ROWS_PER_TASK = 250_000  #: partial groups that one index task takes


class CuckooIndex:
    """A cuckoo filter over live digests with the digests themselves kept beside the fingerprints.

    A bucket holds up to four (fingerprint, digest, value) entries. The fingerprints answer a lookup; every hit
    is verified against the stored digest, so a false positive never merges two texts. An insertion moves
    entries between their two buckets; when that fails, the table is doubled and rebuilt from the stored keys.
    Deletion removes the entry of a live digest.
    """

    def __init__(self, capacity: int = 1024, fingerprint_bits: int = 16, seed: int = 7):
        size = 1
        while size * SLOTS * 0.9 < capacity:
            size *= 2
        self.mask = size - 1
        self.bits = fingerprint_bits
        self.rows = [[] for _ in range(size)]
        self.random = random.Random(seed)
        self.live = self.resizes = self.false_hits = 0

    def _place(self, digest: bytes) -> tuple[int, int]:
        f = int.from_bytes(digest[8:12], "little") & ((1 << self.bits) - 1) or 1
        return int.from_bytes(digest[:8], "little") & self.mask, f

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995)) & self.mask

    def _find(self, digest: bytes) -> list | None:
        bucket, f = self._place(digest)
        for b in (bucket, self._other(bucket, f)):
            for entry in self.rows[b]:
                if entry[0] == f:
                    if entry[1] == digest:
                        return entry
                    self.false_hits += 1
        return None

    def get(self, digest: bytes):
        """The value of a live digest, or None."""
        entry = self._find(digest)
        return entry and entry[2]

    def insert(self, digest: bytes, value) -> None:
        """Add a digest, or replace the value of a live one."""
        entry = self._find(digest)
        if entry:
            entry[2] = value
            return
        bucket, f = self._place(digest)
        self.live += 1
        self._put([f, digest, value], bucket)

    def _put(self, entry: list, bucket: int) -> None:
        for _ in range(MAX_KICKS):
            for b in (bucket, self._other(bucket, entry[0])):
                if len(self.rows[b]) < SLOTS:
                    self.rows[b].append(entry)
                    return
            bucket = self._other(bucket, entry[0])
            k = self.random.randrange(SLOTS)
            self.rows[bucket][k], entry = entry, self.rows[bucket][k]
        self._grow(entry)

    def _grow(self, homeless: list) -> None:
        entries = [e for row in self.rows for e in row] + [homeless]
        self.mask = 2 * self.mask + 1
        self.resizes += 1
        self.rows = [[] for _ in range(self.mask + 1)]
        for e in entries:
            self._put(e, self._place(e[1])[0])

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it is not live."""
        bucket, f = self._place(digest)
        for b in (bucket, self._other(bucket, f)):
            for k, entry in enumerate(self.rows[b]):
                if entry[0] == f and entry[1] == digest:
                    self.rows[b].pop(k)
                    self.live -= 1
                    return True
        return False


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        raw, offs = raw_text(batch.column(1))
        data = raw.tobytes().lower()  # bytes.lower() changes A-Z only
        out = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "digest"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (digest, part, top, at, n): fold them into one index; give each row its whole group's facts.

    The value of a digest is [doc_id, row] of the row that stays, and the group's size.
    """
    index, digests, parts = CuckooIndex(), [], []
    least = -(1 << 63)
    for batch in batches:
        d, p, top, at, n = (batch.column(k).to_pylist() for k in range(5))
        for digest, t, r, m in zip(d, top, at, n, strict=True):
            rank = (t is not None, least if t is None else t, -r)
            have = index.get(digest)
            if have is None:
                index.insert(digest, [rank, m])
            else:
                have[0] = max(have[0], rank)
                have[1] += m
        digests += d
        parts += p
    for at in range(0, len(digests), 10_000):
        chunk = digests[at : at + 10_000]
        facts = [index.get(d) for d in chunk]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(chunk, pa.binary()),
                pa.array(parts[at : at + 10_000], pa.int64()),
                pa.array([f[0][1] if f[0][0] else None for f in facts], pa.int64()),
                pa.array([-f[0][2] for f in facts], pa.int64()),
                pa.array([f[1] for f in facts], pa.int64()),
            ],
            ["digest", "part", "keep_id", "keep_row", "group_size"],
        )


def dedup_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of doc_id, digest, row, part; facts of keep_id, keep_row and group_size for each digest and part)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(_digests), "doc_id long, digest binary")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows.withColumn("part", F.shiftright("row", 33)), "digests")
    # Nulls sort first in a struct, so a null doc_id is the smallest; of equal doc_ids the first row wins.
    partial = rows.groupBy("digest", "part").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("r"))).alias("top"), F.count(F.lit(1)).alias("n"))
    partial = partial.select("digest", "part", F.col("top.doc_id").alias("top"), (-F.col("top.r")).alias("at"), "n")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
    facts = partial.repartition(tasks, "digest").mapInArrow(released(_fold), "digest binary, part long, keep_id long, keep_row long, group_size long")
    return rows, facts


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts; null doc_ids come last; repeated rows (same doc_id and text) keep one row;
    an empty table gives an empty result; other columns are ignored.
    """
    rows, facts = dedup_index(docs)
    return rows.join(facts, ["digest", "part"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without exact copies, all columns kept, whatever they are called.

    Survivors are matched on digest and doc_id; of repeated rows with the surviving doc_id one stays. A null text counts
    as empty, and of all empty texts one stays; a null doc_id gives way to any other. Very long texts are hashed whole.
    No rows give no rows.
    """
    _, facts = dedup_index(docs)
    plain, names, back = unnamed(docs)
    keys = ["digest", "id", "none"]
    identity = lambda c: {"id": F.coalesce(F.col(c).cast("long"), F.lit(0)), "none": F.col(c).isNull()}
    facts = facts.withColumns(identity("keep_id")).select(*keys).distinct()
    digest = F.unhex(F.sha2(F.translate(F.coalesce(F.col(names["text"]).cast("string"), F.lit("")), UPPER, UPPER.lower()), 256))
    full = plain.withColumns(identity(names["doc_id"])).withColumn("digest", digest).join(facts, keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return back(full.withColumn("nth", first).filter("nth = 1"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
