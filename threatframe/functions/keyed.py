"""Keyed state in files: tables of which a change rewrites only the hash buckets that hold its keys, and logs by bucket.

A table is a folder of bucket files, each written by one numbered change, and a manifest for every change that says which
change wrote each bucket. A change is readable once its manifest is there, and doing it again gives the same table, so a job
that is repeated after a failure neither loses nor doubles rows. Readers name the change they want to see.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threatframe.functions.staging import read_texts, removed, staged, write_text


def _bucket(by: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int").alias("bucket")


def _numbers(keys: DataFrame, by: tuple[str, ...], buckets: int) -> list[int]:
    """The buckets of some keys: at most as many numbers as there are buckets."""
    return sorted(r.bucket for r in keys.select(_bucket(by, buckets)).distinct().collect())


def _with(schema: StructType, more: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


class KeyedTable:
    """Rows under keys. `by`: the key columns that choose the bucket, so that rows may be asked for by these alone.

    Key columns hold no nulls. Several rows may share a key; they come and go together.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...], by: tuple[str, ...] | None = None, buckets: int = 16):
        self.spark, self.path, self.key, self.by, self.buckets = spark, path, key, by or key, buckets
        self.schema = StructType.fromDDL(schema)

    def _manifests(self) -> dict[int, dict[int, int]]:
        """By change: bucket -> the change that wrote it."""
        return {int(n): {int(b): c for b, c in json.loads(text()).items()} for n, text in read_texts(self.spark, f"{self.path}/manifest").items()}

    def _manifest(self, at: int) -> dict[int, int]:
        """Of the last change numbered `at` or less."""
        found = {int(n): text for n, text in read_texts(self.spark, f"{self.path}/manifest").items() if int(n) <= at}
        return {int(b): c for b, c in json.loads(found[max(found)]()).items()} if found else {}

    def _files(self, manifest: dict[int, int], only: list[int] | None = None) -> DataFrame:
        wanted: dict[int, list[int]] = {}
        for bucket, change in manifest.items():
            if only is None or bucket in only:
                wanted.setdefault(change, []).append(bucket)
        if not wanted:
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))
        found = self.spark.read.schema(_with(self.schema, "change long, bucket int")).parquet(f"{self.path}/data")
        these = reduce(lambda a, b: a | b, ((F.col("change") == c) & F.col("bucket").isin(bs) for c, bs in wanted.items()))
        return found.filter(these).select(*self.schema.names)

    def read(self, at: int) -> DataFrame:
        """All rows as of a change."""
        return self._files(self._manifest(at))

    def of(self, keys: DataFrame, at: int) -> DataFrame:
        """The rows of keys (which have the columns of `by`, or of the whole key) as of a change; other buckets are not read."""
        on = [c for c in self.key if c in keys.columns]
        return self._files(self._manifest(at), _numbers(keys, self.by, self.buckets)).join(keys.select(*on).distinct(), on, "left_semi")

    def replace(self, number: int, rows: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Change `number`: the rows of the keys in `gone`, and of those in rows, give way to rows. Returns the buckets that it
        wrote; all others stay as the change before left them."""
        rows = staged(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)), "change")
        keys = rows.select(*self.key)
        keys = (keys.unionByName(gone.select(*self.key)) if gone is not None else keys).distinct()
        before, touched = self._manifest(number - 1), _numbers(keys, self.by, self.buckets)
        kept = self._files(before, touched).join(keys, list(self.key), "left_anti")
        out = kept.unionByName(rows).withColumn("bucket", _bucket(self.by, self.buckets)).hint("rebalance", "bucket")
        out.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/change={number}")
        write_text(self.spark, f"{self.path}/manifest/{number}", json.dumps(before | dict.fromkeys(touched, number)))
        return touched

    def vacuum(self, at: int) -> list[int]:
        """Delete the files of changes that change `at` and later ones no longer need; their numbers."""
        every = self._manifests()
        needed = {c for n, m in every.items() if n >= at for c in m.values()} | set(self._manifest(at).values())
        idle = sorted(n for n in every if n < at and n not in needed)
        for n in idle:
            removed(self.spark, f"{self.path}/data/change={n}")
        return idle


class KeyedLog:
    """Rows that are only added, a numbered batch at a time, in files by hash bucket of some columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: tuple[str, ...], buckets: int = 16):
        self.spark, self.path, self.by, self.buckets = spark, path, by, buckets
        self.schema = StructType.fromDDL(schema)

    def append(self, number: int, rows: DataFrame) -> None:
        out = rows.select(*self.schema.names).withColumn("bucket", _bucket(self.by, self.buckets)).hint("rebalance", "bucket")
        out.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/batch={number}")

    def _files(self) -> DataFrame:
        return self.spark.read.schema(_with(self.schema, "batch long, bucket int")).parquet(self.path)

    def batch(self, number: int) -> DataFrame:
        """The rows of one batch."""
        return self._files().filter(F.col("batch") == number).select(*self.schema.names)

    def of(self, keys: DataFrame, at: int) -> DataFrame:
        """The rows of keys, of batches up to `at`; other buckets are not read."""
        found = self._files().filter((F.col("batch") <= at) & F.col("bucket").isin(_numbers(keys, self.by, self.buckets))).select(*self.schema.names)
        return found.join(keys.select(*self.by).distinct(), list(self.by), "left_semi")
