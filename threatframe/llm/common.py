"""Helpers that the training-data operators share: staging, Arrow text slices, word hashing and exact ranks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that a Python task handles at once; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
SMALL_SLICE = 256 << 10  #: where much is kept for each byte: signatures, shingle sets, token ids

#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20

#: ASCII white space: the complement of the word class [^\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_own_dir: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is configured, a local session (tests) gets a temporary folder;
    a cluster gets an error, since its machines share no temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own_dir.get(app) or _own_dir.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts lineage, survives lost executors, and
    lets several consumers share one pass over the texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threatframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unnamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """docs with its columns called c0, c1, ...; the new name of each; and the way back, without any column added since.

    Whatever a user's columns are called, none then clashes with a column of ours.
    """
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names, lambda df: df.select(*(F.col(n).alias(c) for c, n in names.items()))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of text rows small, so that very long documents do not fill a Python worker.

    The setting belongs to the session: it must still hold when the lazy plan runs, so it is not taken back.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice's texts are at most `limit` bytes together (or one text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        ends = raw_text(arr)[1][1:]
        ends = ends - raw_text(arr)[1][0]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, base + limit, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def release() -> None:
    """Give back what a Python worker holds but no longer uses: word-hash tables, Arrow's pool, the C heap's free pages."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches whose worker, which later stages use again, keeps none of its memory."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return mapped


def raw_text(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its row offsets; a null row is an empty range."""
    if pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, dtype=np.int32, count=len(arr) + arr.offset + 1)[arr.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """Words ([^\\x20\\x09-\\x0D]+) of many texts: byte ranges, and each text's range of words."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw, self.offs = raw, offs
        n = len(raw)
        word = np.zeros(n + 2, dtype=np.int8)
        if n:
            word[1:-1] = ~SPACE[raw]
        edge = np.diff(word)
        starts = edge[:-1] == 1
        ends = edge[1:] == -1
        # A text's end also ends a word, and the next text's first byte starts one.
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        both = inner[(word[inner] == 1) & (word[inner + 1] == 1)]
        starts[both] = True
        ends[both - 1] = True
        self.start = np.flatnonzero(starts[:n]) if n else np.zeros(0, np.int64)
        self.end = np.flatnonzero(ends[:n]) + 1 if n else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offs)  # of each text; one more entry than texts
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; `second` gives one of other byte codes and another base."""
        code, base = (_BYTE2, _BASE2) if second else (_BYTE, _BASE)
        if not len(self):
            return np.zeros(0, np.uint64)
        # As range_hash, but words do not overlap, so powers reach only as far as the longest word.
        size = self.end - self.start
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(begin, size)
        values = code[self.raw[~SPACE[self.raw]]] * _power_tables(base, int(size.max()))[0][place]
        return mix(mix(np.add.reduceat(values, begin)) + size.astype(np.uint64) + np.uint64(1))

    def text(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


def words_of(arr: pa.Array) -> Words:
    return Words(*raw_text(arr))


def joined(w: Words) -> list[bytes]:
    """Each text's words joined by one space."""
    raw, n = w.raw, len(w.raw)
    if not n:
        return [b""] * (len(w.offs) - 1)
    size = w.end - w.start
    last = np.zeros(len(w), bool)
    last[w.first[1:][w.count > 0] - 1] = True
    full = size + ~last  # a space after all but the last
    begin = np.concatenate(([0], np.cumsum(full)))
    out = np.full(begin[-1], 0x20, np.uint8)
    inside = ~SPACE[raw]
    out[np.repeat(begin[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())] = raw[inside]
    data, cut = out.tobytes(), begin[w.first]
    return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply): spreads the bits of sums and products."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x2545F4914F6CDD1D | 5)
_BYTE2 = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE5AB))
_BASE2 = np.uint64(0x9FB21C651E98DF25)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, base, np.uint64))), dtype=np.uint64)
            down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, inverse, np.uint64))), dtype=np.uint64)
        have = _powers[int(base)] = (up, down)
    return have


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of values[start:end] for many ranges at once, by prefix sums."""
    n = len(values)
    if not n or not len(start):
        return np.zeros(len(start), np.uint64)
    up, down = _power_tables(base, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * down[start]) + (end - start).astype(np.uint64)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges that first delimits (empty ranges give 0)."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


IDENTITY = ["digest", "id", "none"]  #: of a row: digest of its words, doc_id (0 if null), whether that is null
BLOOM_BYTES = 8 << 20  #: of a Bloom filter, at most, however many rows it stands for


def identified(df: DataFrame, column: str) -> DataFrame:
    """Adds the null-safe form of a doc_id column: id and none."""
    return df.withColumns({"id": F.coalesce(F.col(column).cast("long"), F.lit(0)), "none": F.col(column).isNull()})


def _bloom_places(digests: list[bytes], ids: pa.Array, bits: int) -> np.ndarray:
    """(rows, 2) places in a Bloom filter of `bits` bits, from a row's digest and doc_id."""
    words = np.frombuffer(b"".join(d[:16] for d in digests), "<u8").reshape(-1, 2)
    own = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64) + np.asarray(ids.is_null()).astype(np.uint64) * np.uint64(0x632BE5AB)
    return (mix(words + mix(own + np.uint64(1))[:, None]) % np.uint64(bits)).astype(np.int64)


def _bloom(rows: DataFrame) -> np.ndarray:
    """The bits of a Bloom filter of (digest, id, none) rows: about twelve a row, and at most BLOOM_BYTES."""
    bits = min(8 * BLOOM_BYTES, max(1 << 12, 12 * rows.count() // 64 * 64))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bloom_places(batch.column(0).to_pylist(), batch.column(1), bits))
            word, first = np.unique(at >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

    ids = rows.select("digest", F.when(~F.col("none"), F.col("id")).alias("id"))
    got = ids.mapInArrow(released(words), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(got["word"])] = np.asarray(got["mask"])
    return out


def with_texts(wanted: DataFrame, texts: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """Rows of (digest, id, none, ...) with `text`, from one more scan of texts (doc_id long, text string).

    digest is what the rows' digests were made with, from a text's words joined by one space. A Bloom filter of the wanted
    rows keeps nearly all other texts out of the shuffle; its size is bounded, so where rows are very many it lets more
    texts through, and the join removes those. A wanted row that texts repeat comes once.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches):
            digests = [digest(t) for t in joined(Words(*raw_text(batch.column(1))))]
            at = _bloom_places(digests, batch.column(0), 64 * len(table))
            hit = ((table[at >> 6] >> (at & 63)) & 1).all(axis=1)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], ["doc_id", "text", "digest"])
            yield out.filter(pa.array(hit))

    found = identified(texts.mapInArrow(released(run), "doc_id long, text string, digest binary"), "doc_id").drop("doc_id")
    return wanted.join(found.dropDuplicates(IDENTITY), IDENTITY)


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """Exact 0-based ranks without a task that holds a whole key: adds `rank` and `key_rows`.

    `bucket` must be monotone in `order`. Each (key, bucket) is numbered by itself; the buckets' counts, summed
    in bucket order, give the offsets. keys must not hold nulls.
    """
    df = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *by,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("key_rows"),
    )
    own = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return (
        df.withColumn("_own", own)
        .join(counts, by)
        .withColumn("rank", F.col("_before") + F.col("_own") - 1)
        .drop("_bucket", "_own", "_before")
    )


def buckets_for(rows: int, per_bucket: int = 4000, least: int = 1024) -> int:
    return max(least, -(-rows // per_bucket))


#: Words of documents with their places, for DuckDB: w (doc_id, p, word).
WORDS_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
 w AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM d)"""


def run_sql(words: int, of: str = "w") -> str:
    """A hash of the run of so many words from each place, in SQL; null where the text ends before."""
    frame = f"(PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {words - 1} FOLLOWING)"
    return f"SELECT doc_id, p, CASE WHEN count(*) OVER {frame} = {words} THEN md5(string_agg(word, ' ') OVER {frame}) END AS h FROM {of}"
