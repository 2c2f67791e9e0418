"""Chain of custody of a stream: every micro-batch is stored with a digest that is linked to the one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.staging import temporary
from threatframe.operators import reports

NONE = "0" * 64
LINK = "events long, digest string, prev_hash string, chain_hash string"


class Custody:
    """Rows and links of a stream in one folder, whoever writes them: a restarted stream links to what the one before left.

    `order` tells the events of a batch apart, `text` is what a digest covers of an event.
    """

    def __init__(self, spark: SparkSession, path: str, order: str, text: Column, fan_in: int = reports.CHUNK):
        self.spark, self.path, self.order, self.text, self.fan_in = spark, path, order, text, fan_in

    def link(self, batch: DataFrame, number: int) -> None:
        """Store a batch and its link. Done again after a failure, it gives the same link. An empty batch has none; the next
        one links to the last before it."""
        rows = f"{self.path}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(rows)
        with temporary(self.spark):
            stored = self.spark.read.schema(batch.schema).parquet(rows)
            new = reports.batch_digests(stored, F.lit(number).cast("long"), self.order, self.text, self.fan_in).first()
            if new is None:
                return
            before = self._links().filter(F.col("job") < number).orderBy(F.desc("job")).first() if number else None
            prev = before.digest if before else NONE
            one = self.spark.createDataFrame([(new.events, new.digest, prev)], "events long, digest string, prev_hash string")
            one.withColumn("chain_hash", F.sha2(F.concat("prev_hash", "digest"), 256)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/links/batch={number}")

    def _links(self) -> DataFrame:
        return self.spark.read.schema(f"{LINK}, batch long").parquet(f"{self.path}/links").withColumnRenamed("batch", "job")

    def links(self) -> DataFrame:
        """(job, events, digest, prev_hash, chain_hash), one row per batch."""
        return self._links().select("job", "events", "digest", "prev_hash", "chain_hash")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def faults(self) -> DataFrame:
        """(job, fault): batches whose rows no longer give their digest, whose link does not lead to the batch before, or of
        which rows or link are missing."""
        now = reports.batch_digests(self.rows(), F.col("batch").cast("long"), self.order, self.text, self.fan_in)
        return reports.broken_links(self.links(), now)
