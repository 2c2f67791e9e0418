"""Operator 10: mixing sources to target weights by pivotal dependent rounding.

Every document gets an expected number of copies, its source's target divided by its source's size (0 to 2). The
whole part is taken as it is; the fractional parts are rounded together: two fractional documents exchange mass,
measured in words, until one of them is integral, which keeps the expected copies of each document and the words of
their sum. Documents are paired within (source, bucket) first; each bucket leaves at most one fractional document,
and a reduction tree pairs these residuals in rounds of FAN_IN buckets until a source has one left. That one is
rounded by a coin flip, so a source's words miss its target by less than one document. Every pairing, on every level,
and the last flip have a coin of their own, so no draw is used twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatframe.llm.common import buckets_for, read, released, slices, small_batches, staged, unnamed, words_of

WEIGHTS = (3, 1, 2)  #: of the sources in order, repeating
SHARE = 1.5  #: words of the mix against all words
MOST = 2  #: a target against its source's size
FAN_IN = 256
SEED = 20
_EPS = 1e-9


def _sizes(batches):
    for batch in slices(batches, "text"):
        w = words_of(batch.column(batch.schema.get_field_index("text")))
        keep = [k for k, f in enumerate(batch.schema.names) if f != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(w.count, pa.int64())], [*(batch.schema.names[k] for k in keep), "size"])


def _hashed(column: str):
    return F.xxhash64(column).alias("text_hash"), F.col(column).cast("string").alias("text")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> adds `target`, one row per source.

    Water filling in closed form: with a common level v, a source gets min(weight * v, MOST * size). Sorted by the
    level at which a source is full, the level of the rest follows from running sums. One row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    s = s.withColumns({"_full": F.col("source_size") * MOST / F.col("_weight"), "_all": F.sum("source_size").over(Window.partitionBy())})
    up = Window.orderBy("_full", F.col("source").isNull(), "source")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    level = (SHARE * F.col("_all") - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_weight").over(after)
    s = s.withColumn("_level", level)
    # The first source, in order, that is not full at its own level sets the level of itself and all later ones.
    s = s.withColumn("_v", F.min(F.when(F.col("_level") < F.col("_full"), F.struct("_full", "_level"))).over(Window.partitionBy())["_level"])
    cap = (F.col("source_size") * MOST).cast("double")
    return s.select("source", "source_size", F.when(F.col("_v").isNull(), cap).otherwise(F.least(cap, F.col("_weight") * F.col("_v"))).alias("target"))


def coin(*keys: int) -> float:
    """A number from 0 to 1 that follows from the keys: one round of xor, multiply and shift for each."""
    x = 0x9E3779B97F4A7C15
    for k in keys:
        x = ((x ^ (k & _LONG)) * 0xBF58476D1CE4E5B9) & _LONG
        x ^= x >> 29
        x = (x * 0x94D049BB133111EB) & _LONG
        x ^= x >> 32
    return (x >> 11) / float(1 << 53)


def _pair_up(seed: int, level: int, last: bool):
    """Rows sorted by (source, bucket): pivotal rounding along each run, in one pass that holds one open row.

    Of two fractional rows at least one becomes integral and goes out; the other stays open. `last` rounds what a
    run leaves open. A pairing's coin follows from the level, its place in the run and both rows.
    """

    def closed(row: list) -> list:
        if last and not _whole(row[P]):
            row[P] = float(coin(seed, level, -1, row[H]) < row[P])
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: list | None = None
        nth = 0
        for batch in batches:
            out = []
            for row in map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if open_row is not None and open_row[1:3] != row[1:3]:
                    out.append(closed(open_row))
                    open_row, nth = None, 0
                if _whole(row[P]):
                    row[P] = float(round(row[P]))
                    out.append(row)
                elif open_row is None:
                    open_row = row
                else:
                    a, b, ratio = open_row[P], row[P], row[SIZE] / open_row[SIZE]
                    gain, loss = min(1 - a, b * ratio), min(a, (1 - b) * ratio)  # what the open row may gain or lose
                    nth += 1
                    move = gain if coin(seed, level, nth, open_row[H], row[H]) * (gain + loss) < loss else -loss
                    open_row[P], row[P] = a + move, b - move / ratio
                    rest = []
                    for x in (open_row, row):
                        if _whole(x[P]):
                            x[P] = float(round(x[P]))
                            out.append(x)
                        else:
                            rest.append(x)
                    open_row = rest[0] if rest else None
            yield _rows(out, batch.schema)
        if open_row is not None:
            yield _rows([closed(open_row)], batch.schema)

    return run


ROW, H, SIZE, P = 0, 3, 4, 5  #: places in (row, s, bucket, h, size, p)
_LONG = (1 << 64) - 1


def _whole(p: float) -> bool:
    return not _EPS < p < 1 - _EPS


def _rows(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema.names)


def copies(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows of (row, doc_id, source, size, text_hash) -> doc_id, size, source_size, target, taken, copies and row.

    The pairing depends on hashes of doc_id, size and text only, not on the input's partitions, so reruns agree, and rows
    that share a doc_id, or have none, stand in different buckets. One row per source is gathered to set the targets; it
    is broadcast where a count finds fewer than 10,000 sources, and joined by a shuffle beyond, with the same rows.
    """
    spark = rows.sparkSession
    n = rows.count()
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("_s", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    h = F.xxhash64(F.lit(seed), "doc_id", "size", "text_hash")
    full = rows.join(F.broadcast(sources) if sources.count() < 10_000 else sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    expected = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    full = full.withColumns({"_whole": F.floor(expected), "p": expected - F.floor(expected), "h": h})
    full = full.withColumn("bucket", F.pmod("h", F.lit(buckets_for(n, 2000))))
    full = staged(full, "mix")
    level = full.select("row", "_s", "bucket", "h", "size", "p")
    done, buckets, left, depth = [], buckets_for(n, 2000), n, 0
    while True:
        last = buckets == 1
        tasks = min(buckets, spark.sparkContext.defaultParallelism + left // 100_000)
        level = level.repartition(tasks, "_s", "bucket").sortWithinPartitions("_s", "bucket", "h", "row")
        level = staged(level.mapInArrow(released(_pair_up(seed, depth, last)), level.schema), "mix-level")
        depth += 1
        whole = F.col("p").isin(0.0, 1.0)
        done.append(level.filter(whole))
        if last:
            break
        level = level.filter(~whole)
        left, buckets = level.count(), -(-buckets // FAN_IN)
        level = level.withColumn("bucket", F.pmod("bucket", F.lit(buckets).cast("long")))
    out = done[0].select("row", "p")
    for d in done[1:]:
        out = out.union(d.select("row", "p"))
    full = full.drop("p").join(out, "row")
    full = full.withColumn("copies", (F.col("_whole") + F.col("p")).cast("int"))
    return full.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies, one row per document.

    Null texts and texts without words have size 0 and are not taken; a null source is the last source. Repeated rows and
    rows that share a doc_id are rounded each for itself. Very long texts are counted whole. No rows give no rows; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *_hashed("text"))
    rows = rows.mapInArrow(released(_sizes), "doc_id long, source string, text_hash long, size long")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    return copies(rows, seed).drop("row", "source")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as many times as the rounding takes it, all columns kept, whatever they are called.

    Null texts and texts without words are not taken; a null source is the last source. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    plain, names, back = unnamed(docs)
    plain = staged(plain.withColumn("row", F.monotonically_increasing_id()), "mix-docs")
    rows = plain.select("row", F.col(names["doc_id"]).cast("long").alias("doc_id"), F.col(names["source"]).cast("string").alias("source"), *_hashed(names["text"]))
    rows = staged(rows.mapInArrow(released(_sizes), "row long, doc_id long, source string, text_hash long, size long"), "mix-sizes")
    taken = copies(rows, seed).filter("copies > 0").select("row", F.sequence(F.lit(1), "copies").alias("copies"))
    return back(plain.join(taken, "row").withColumn("copy", F.explode("copies")))


def op10_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read(spark, sf_dir, "documents"))
