"""Operator 4: sharding by proportional stratified interleaving.

Rows of each source are put in seeded-shuffled order; a row's fractional rank is (rank + 0.5) / rows of its source.
Sorted by fractional rank, any stretch of rows holds every source in its share of the whole, so cutting the order
into stretches of equal row counts gives shards that all match the mixture. Law: `rows`.

Ranks are exact and distributed: hash prefixes divide a source into small buckets (a hot source too), and bucket
counts give offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.llm.common import buckets_for, ranked, read, staged, unnamed

SHARDS = 16
SEED = "shard-1"


def interleave(rows: DataFrame, total: int, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Adds `shard` and `slot` to rows of (doc_id, source, ...): any columns, nulls in any of them (user columns of
    these two names give way; others may be called anything).

    A row's place follows from a hash of all its columns, so rows that share a doc_id or have none are spread. Ties
    (repeated rows) are interchangeable, so reruns agree. A null source is a source of its own. No rows give no rows.
    """
    rows, names, _ = unnamed(rows.drop("shard", "slot"))
    cols = list(names.values())
    b = buckets_for(total)
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(names["doc_id"]).cast("string"), F.lit("null")), F.xxhash64(*cols).cast("string")))
    source = F.col(names["source"])
    rows = rows.withColumns({"_h": h, "_none": source.isNull(), "_s": F.coalesce(source, F.lit(""))})
    prefix = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    ties = [F.col(c) for c in cols]
    rows = ranked(rows, ["_none", "_s"], F.shiftright(prefix * F.lit(b), 32), [F.col("_h"), *ties])
    rows = rows.withColumn("_at", (F.col("rank") + 0.5) / F.col("key_rows")).drop("rank", "key_rows")
    rows = ranked(
        rows.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("_at") * b), [F.col("_at"), F.col("_none"), F.col("_s"), F.col("_h"), *ties]
    )
    shard = F.expr(f"(rank * {shards}) div key_rows")
    rows = rows.withColumn("shard", shard.cast("int"))
    rows = rows.withColumn("slot", F.expr(f"rank - (shard * key_rows + {shards - 1}) div {shards}"))
    return rows.select(*(F.col(n).alias(c) for c, n in names.items()), "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not `key`), one row per document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    rows = staged(rows, "sizes")
    return interleave(rows, rows.count(), shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
