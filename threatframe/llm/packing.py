"""Operator 5: best-two-fit packing of tokenized documents into sequences of at most 4096 tokens.

A document is its tokens followed by one end token; only longer ones are cut, into full pieces and a rest. Packing
looks at lengths only, so the whole table packs as one problem: its histogram has at most CAPACITY rows however many
documents there are. A bin is filled greedily with the longest pieces that fit; then its smallest piece is taken out
for the two unpacked pieces that fill the expanded gap most tightly. The bin so found is repeated as often as the
histogram allows. Pieces get exact ranks within their length (distributed, hot lengths too), and a rank names a bin
and a place in it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.llm.common import buckets_for, per_text, ranked, read, released, slices, small_batches, staged, words_of

CAPACITY = 4096
END = 1  #: the id that closes a document
CACHE_WORDS = 400_000  #: distinct words, and pieces of words, that a task remembers
ENCODED_SLICE = 1 << 20  #: text bytes that are encoded at once: a word that a slice repeats is looked up once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: A run of Latin letters and then ASCII punctuation without an apostrophe: exactly one or two pre-tokens.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")


class WordEncoder:
    """Token ids of single words. The tokenizer drops white space and never joins over it, so a text's ids are its
    words' ids in order; each distinct word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
        self.shown = [shown[b] for b in range(256)]  # the byte-level alphabet

    def _piece(self, s: str) -> tuple[int, ...]:
        got = self.pieces.get(s)
        if got is None:
            got = self.pieces[s] = tuple(t.id for t in self.model.tokenize("".join(map(self.shown.__getitem__, s.encode()))))
        return got

    def word(self, w: bytes) -> tuple[int, ...]:
        got = self.words.get(w)
        if got is None:
            s = w.decode("utf-8", "replace")
            if m := _PLAIN.match(s):
                got = self._piece(m[1].lower()) + (self._piece(m[2]) if m[2] else ())
            else:
                got = tuple(self.tokenizer.encode(s, add_special_tokens=False).ids)
            self.words[w] = got
        return got

    def texts(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each closed by END, and the texts' offsets in them."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        w = words_of(arr)
        _, at, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
        data, start, end = w.raw.tobytes(), w.start[at].tolist(), w.end[at].tolist()
        ids = [self.word(data[a:b]) for a, b in zip(start, end, strict=True)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size
        of_word = size[which]
        offs = np.concatenate(([0], np.cumsum(per_text(of_word, w.first) + 1)))
        out = np.full(offs[-1], END, np.uint32)
        before = np.cumsum(of_word) - of_word
        place = np.arange(of_word.sum())
        out[place + np.repeat(w.doc, of_word)] = flat[place + np.repeat(begin[which] - before, of_word)]
        return out, offs


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        for batch in slices(batches, limit=ENCODED_SLICE):
            ids, offs = encoder.texts(batch.column(1))
            data, rows = memoryview(ids.astype("<u4").tobytes()), []
            for k in range(batch.num_rows):
                a, n = int(offs[k]), int(offs[k + 1] - offs[k])
                for piece, start in enumerate(range(0, n, CAPACITY)):
                    length = min(CAPACITY, n - start)
                    rows.append((k, piece, start, length, zlib.crc32(data[4 * (a + start) : 4 * (a + start + length)])))
            k, piece, start, length, crc = (np.array(c) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(k)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for a histogram of lengths: [(times, [(length, pieces of it in the bin)])]."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    lengths = np.arange(capacity + 1)
    while left.any():
        free = left.copy()
        top = np.maximum.accumulate(np.where(free > 0, lengths, 0))  # the longest available up to each length
        taken: dict[int, int] = {}
        gap = capacity
        while gap > 0 and (x := int(top[gap])):
            n = min(int(free[x]), gap // x)
            taken[x] = taken.get(x, 0) + n
            free[x] -= n
            gap -= n * x
            if free[x] == 0:
                top = np.maximum.accumulate(np.where(free > 0, lengths, 0))
        small = min(taken)
        if gap and not (len(taken) == 1 and taken[small] == 1):
            wide = gap + small
            a = np.flatnonzero(free[: wide + 1] > 0)
            if len(a):
                b = top[wide - a]
                # Two of one length need two of them; else the next shorter one joins it.
                alone = (a == b) & (free[a] < 2)
                lower = np.concatenate(([0], top[:-1]))
                b = np.where(alone, lower[a], b)
                total = np.where(b > 0, a + b, 0)
                k = int(np.argmax(total))
                if total[k] > small:
                    taken[small] -= 1
                    free[small] += 1
                    for x in (int(a[k]), int(b[k])):
                        taken[x] = taken.get(x, 0) + 1
        taken = {x: n for x, n in taken.items() if n}
        times = min(int(left[x]) // n for x, n in taken.items())
        for x, n in taken.items():
            left[x] -= times * n
        bins.append((times, sorted(taken.items(), reverse=True)))
    return bins


def _places(bins: list) -> dict[str, np.ndarray]:
    """For each length, which ranks stand in which bins: rows sorted by length and first rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, items in bins:
        at = 0
        for length, n in items:
            rows.append(((length << 48) | used.get(length, 0), times, sequence, at))
            used[length] = used.get(length, 0) + times * n
            at += length * n
        sequence += times
    rows.sort()
    return {k: np.array([r[j] for r in rows], np.int64) for j, k in enumerate(("key", "times", "sequence", "at"))}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to capacity (columns as in PIECES)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(_places(best_two_fit(counts, capacity)))
    names = pieces.columns
    h = F.xxhash64("doc_id", "piece", "ids_crc32")
    high = F.shiftrightunsigned(h, 33)
    ranks = ranked(pieces.withColumns({"_high": high, "_h": h}), ["length"], F.shiftright(F.col("_high") * F.lit(buckets_for(sum(counts.values()))), 31), [F.col("_high"), F.col("_h"), *map(F.col, names)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(k))) for k in ("length", "rank"))
            k = np.searchsorted(p["key"], (length << 48) | rank, side="right") - 1
            i = rank - (p["key"][k] & ((1 << 48) - 1))
            sequence, offset = p["sequence"][k] + i % p["times"][k], p["at"][k] + i // p["times"][k] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in range(len(names))), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranks.select(*names, "rank").mapInArrow(released(place), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end token alone; repeated rows are packed each for itself; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(_pieces(tokenizer_path)), PIECES)
    return pack_pieces(staged(pieces, "pieces"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())
