"""Operator 7: removal of passages of 50 words that an earlier document holds, behind a count-min prefilter.

A window is 50 consecutive words. Each window is named by its anchor, the least of its 41 ten-word hashes: equal windows
have equal anchors, and neighbouring windows mostly share one, so a document has about one anchor for 20 windows.

1. One pass hashes every text: digest of its words, and its distinct anchors. Texts of equal words are one class; all
   but those of the smallest doc_id are wholly covered, and a class goes on as one text.
2. Each task sketches its classes' anchors in a blocked count-min table, over all its batches; the partial sketches are
   merged by block. A window that stands in two classes gives both the same anchor, so an anchor's estimate is never
   below the count of any window of it: the sketch overestimates window counts while it counts a twentieth as many
   things, and windows whose anchor is estimated once cannot repeat. The sketch is itself a distributed table, sized by the corpus, and is looked up by a
   join on its block: nothing is broadcast.
3. Texts with anchors estimated repeated are read again. A run of windows with one anchor is a segment; segments are
   grouped by two independent 64-bit hashes, and where an anchor has several different segments, so are their windows.
4. A window goes where its smallest doc_id is smaller than the document's own; the kept words are hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.llm.common import WORDS_SQL, Words, identified, joined, mix, range_hash, raw_text, read, run_sql, slices, small_batches, staged, with_texts

WINDOW = 50
GRAM = 10  #: words that an anchor's hash covers
BLOCK = 4096  #: counters of a sketch block, in two rows
PER_BLOCK = 256  #: anchors that a block is meant for
UNIT = 4096  #: blocks that one merge takes, at most
HELD = 4 << 20  #: counted cells that a task holds before it gives out a partial sketch
EMPTY = hashlib.sha256(b"").hexdigest()
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def anchors(w: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window among all words, its anchor), in order."""
    gram = min(GRAM, window)
    n = len(w)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    low = range_hash(w.hashes(), at, at + gram, _BASES[0])
    need, have = window - gram + 1, 1
    while have < need:  # sliding minimum by doubling
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    start = np.arange(n - window + 1)
    whole = w.doc[start] == w.doc[start + window - 1]
    return start[whole], low[whole]


def _profiles(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(*raw_text(batch.column(1)))
            digests = [hashlib.sha256(t).digest() for t in joined(w)]
            start, low = anchors(w, window)
            order = np.lexsort((low, w.doc[start]))
            doc, low = w.doc[start][order], low[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])
            offs = np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=batch.num_rows)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(low[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(w.count, pa.int64()), lists], ["doc_id", "digest", "n_words", "anchors"])

    return run


def _cells(low: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, two cells in it) of each anchor; the two rows of a block share it out in halves."""
    h = mix(low ^ np.uint64(0x5851F42D4C957F2D))
    half = np.uint64(BLOCK // 2 - 1)
    block = (h % np.uint64(blocks)).astype(np.int64)
    g = mix(h)
    return block, np.stack([g & half, ((g >> np.uint64(20)) & half) + np.uint64(BLOCK // 2)], axis=1).astype(np.int64)


def _partial_sketch(blocks: int, width: int):
    """Anchors -> (unit, cells): the cells that this task counts once, or twice (counters saturate at 2). A unit is
    `width` neighbouring blocks, so that a task makes few rows; a task gives out what it has after HELD cells."""

    def merged(held: list[np.ndarray]) -> np.ndarray:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return np.repeat(key, np.minimum(n, 2))

    def given(key: np.ndarray) -> pa.RecordBatch:
        of, begin = np.unique(key // (width * BLOCK), return_index=True)
        offs = (4 * np.append(begin, len(key))).astype(np.int32)
        data = (key % (width * BLOCK)).astype("<u4").tobytes()
        cells = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), cells], ["unit", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            low = np.asarray(batch.column(0).flatten()).view(np.uint64)
            block, cells = _cells(low, blocks)
            held.append((block[:, None] * BLOCK + cells).ravel())
            size += len(held[-1])
            if size > HELD:
                held = [merged(held)]
                size = len(held[0])
                if size > HELD // 2:
                    yield given(held[0])
                    held, size = [], 0
        if size:
            yield given(merged(held))

    return run


def _merged_sketch(width: int):
    """(unit, lists of cells) -> (block, a bit for each cell that was counted twice or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                count = np.bincount(np.frombuffer(b"".join(p.as_py() for p in parts.values), "<u4"), minlength=width * BLOCK)
                bits = np.packbits(count >= 2, bitorder="little").view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(width + 1) * (BLOCK // 64), pa.int32()), pa.array(bits))
                yield pa.RecordBatch.from_arrays([pa.array(unit * width + np.arange(width)), lists], ["block", "bits"])

    return run


def _placed(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            which = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            low = np.asarray(lists.flatten())
            block, cells = _cells(low.view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which)), pa.array(low), pa.array(block), *(pa.array(cells[:, k].astype(np.int32)) for k in (0, 1))], ["digest", "anchor", "block", "c0", "c1"]
            )

    return run


def estimated_repeated(classes: DataFrame) -> DataFrame:
    """(digest, anchors) of one row per class -> (digest, anchors that the sketch counts twice or more)."""
    total = classes.agg(F.sum(F.size("anchors"))).first()[0] or 0
    blocks = max(64, -(-total // PER_BLOCK))
    width = max(1, min(UNIT, blocks // 256))
    partial = classes.select("anchors").mapInArrow(_partial_sketch(blocks, width), "unit long, cells binary")
    sketch = partial.groupBy("unit").agg(F.collect_list("cells").alias("cells")).mapInArrow(_merged_sketch(width), "block long, bits array<long>")
    sketch = staged(sketch, "sketch")
    placed = classes.select("digest", "anchors").mapInArrow(_placed(blocks), "digest binary, anchor long, block long, c0 int, c1 int")
    bit = lambda c: F.expr(f"shiftrightunsigned(bits[shiftright({c}, 6)], {c} & 63) & 1") == 1
    hit = placed.join(sketch, "block").filter(bit("c0") & bit("c1"))
    return hit.groupBy("digest").agg(F.collect_list("anchor").alias("anchors"))


SEGMENTS = "digest binary, text string, first_word array<int>, windows array<int>, anchor array<long>, seg1 array<long>, seg2 array<long>"
WINDOWS = "anchor long, seg1 long, seg2 long, first_id long, at int, win1 long, win2 long"


def _segments(window: int):
    """(digest, text, anchors) -> the text's segments with those anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(*raw_text(batch.column(1)))
            start, low = anchors(w, window)
            doc = w.doc[start]
            lists = batch.column(2)
            wanted = np.asarray(lists.flatten()).view(np.uint64)
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            salt = mix(np.arange(1, batch.num_rows + 1, dtype=np.uint64))
            hit = np.isin(low ^ salt[doc], wanted ^ salt[of])
            start, low, doc = start[hit], low[hit], doc[hit]
            new = np.ones(len(start), bool)
            new[1:] = (start[1:] != start[:-1] + 1) | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(start)))
            a, b = start[begin], start[begin] + size + window - 1
            seg = [range_hash(w.hashes(second), a, b, base).view(np.int64) for second, base in enumerate(_BASES)]
            offs = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[begin], minlength=batch.num_rows)))).astype(np.int32))
            first_word = (a - w.first[doc[begin]]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offs, pa.array(x)) for x in (first_word, size.astype(np.int32), low[begin].view(np.int64), *seg)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["digest", "text", "first_word", "windows", "anchor", "seg1", "seg2"])

    return run


def _windows(window: int):
    """(text, list of segments) -> a row for each window of those segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(*raw_text(batch.column(0)))
            lists = batch.column(1)
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            seg = lists.flatten()
            field = lambda name: seg.field(seg.type.get_field_index(name))
            n, first_word = np.asarray(field("windows")).astype(np.int64), np.asarray(field("first_word"))
            which = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = (w.first[of] + first_word)[which] + at
            win = [range_hash(w.hashes(second), start, start + window, base).view(np.int64) for second, base in enumerate(_BASES)]
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [*(field(k).take(take) for k in ("anchor", "seg1", "seg2", "first_id")), pa.array(at.astype(np.int32)), *map(pa.array, win)], ["anchor", "seg1", "seg2", "first_id", "at", "win1", "win2"]
            )

    return run


def _kept(window: int):
    """(digest, min_id, text, spans of (first_word, windows, first_id, firsts)) -> removed words, digest of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(*raw_text(batch.column(2)))
            gone = np.zeros(len(w) + 1, np.int64)
            for k, (own, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                base = int(w.first[k])
                for s in spans:
                    a = base + s["first_word"]
                    if s["firsts"] is None:
                        if s["first_id"] is not None and (own is None or s["first_id"] < own):
                            gone[a] += 1
                            gone[a + s["windows"] + window - 1] -= 1
                    else:
                        for i, first in enumerate(s["firsts"]):
                            if first is not None and (own is None or first < own):
                                gone[a + i] += 1
                                gone[a + i + window] -= 1
            keep = np.cumsum(gone[:-1]) == 0
            shas, removed, data = [], [], w.raw.tobytes()
            for k in range(batch.num_rows):
                span = np.arange(w.first[k], w.first[k + 1])
                left = span[keep[span]]
                removed.append(len(span) - len(left))
                shas.append(hashlib.sha256(b" ".join([data[x:y] for x, y in zip(w.start[left].tolist(), w.end[left].tolist(), strict=True)])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(shas)], ["digest", "removed", "sha"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per document.

    Null texts have no words. A null doc_id counts as larger than any other and removes nothing elsewhere; rows that
    repeat a doc_id do not remove one another's words. Texts shorter than a window stay whole; very long ones are read
    whole. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(texts.mapInArrow(_profiles(window), "doc_id long, digest binary, n_words long, anchors array<long>"), "profiles")
    classes = rows.filter(F.col("n_words") >= window).groupBy("digest").agg(F.min("doc_id").alias("min_id"), F.first("anchors").alias("anchors"))
    classes = staged(classes, "classes")
    picked = estimated_repeated(classes).join(classes.select("digest", "min_id"), "digest")
    picked = staged(identified(picked, "min_id").select("digest", "id", "none", "anchors"), "picked")
    found = with_texts(picked, texts, lambda t: hashlib.sha256(t).digest()).select("digest", "text", "anchors")
    found = staged(found.mapInArrow(_segments(window), SEGMENTS), "segments")

    # Segments: exact groups by 128 bits; the smallest doc_id that holds each.
    flat = found.select("digest", F.explode(F.arrays_zip("first_word", "windows", "anchor", "seg1", "seg2")).alias("s")).select("digest", "s.*")
    flat = staged(flat.join(classes.select("digest", "min_id"), "digest"), "segment-rows")
    one = F.min(F.struct("digest", "first_word", "windows")).alias("one")
    groups = staged(flat.groupBy("anchor", "seg1", "seg2").agg(F.min("min_id").alias("first_id"), F.count(F.lit(1)).alias("n"), one), "groups")
    several = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1")

    # Windows of anchors with several different segments: each different segment brings its windows once.
    parts = groups.join(staged(several.select("anchor"), "several"), "anchor").select("one.*", "anchor", "seg1", "seg2", "first_id")
    parts = parts.groupBy("digest").agg(F.collect_list(F.struct("first_word", "windows", "anchor", "seg1", "seg2", "first_id")).alias("segs"))
    texts_of = found.select("digest", "text")
    wins = staged(texts_of.join(parts, "digest").select("text", "segs").mapInArrow(_windows(window), WINDOWS), "windows")
    firsts = staged(wins.groupBy("win1", "win2").agg(F.min("first_id").alias("first")), "window-groups")
    firsts = wins.join(firsts, ["win1", "win2"]).groupBy("anchor", "seg1", "seg2").agg(F.array_sort(F.collect_list(F.struct("at", "first"))).alias("f"))
    facts = groups.join(firsts, ["anchor", "seg1", "seg2"], "left").filter((F.col("n") > 1) | F.col("f").isNotNull())
    facts = staged(facts.select("anchor", "seg1", "seg2", "first_id", F.col("f.first").alias("firsts")), "facts")

    spans = flat.join(facts, ["anchor", "seg1", "seg2"]).filter(
        F.coalesce(F.col("first_id") < F.col("min_id"), F.col("first_id").isNotNull() & F.col("min_id").isNull()) | F.exists("firsts", lambda f: F.coalesce(f < F.col("min_id"), F.lit(True)))
    )
    spans = spans.groupBy("digest").agg(F.first("min_id").alias("min_id"), F.collect_set(F.struct("first_word", "windows", "first_id", "firsts")).alias("spans"))
    results = spans.join(texts_of, "digest").select("digest", "min_id", "text", "spans")
    results = results.mapInArrow(_kept(window), "digest binary, removed long, sha string")
    results = classes.select("digest", "min_id").join(results, "digest", "left")
    results = staged(results, "kept")
    copy = (F.col("doc_id") > F.col("min_id")) | (F.col("doc_id").isNull() & F.col("min_id").isNotNull())
    out = rows.select("doc_id", "digest", "n_words").join(results, "digest", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def op7_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


#: The contract in SQL: a word goes where a run of 50 words around it starts in a smaller doc_id too.
OP7_SQL = f"""{WORDS_SQL}, r AS MATERIALIZED ({run_sql(WINDOW)}), f AS (SELECT h, min(doc_id) AS first FROM r WHERE h IS NOT NULL GROUP BY h),
 b AS (SELECT r.doc_id, p, coalesce(f.first < r.doc_id, false) AS bad FROM r LEFT JOIN f USING (h)),
 c AS (SELECT doc_id, p, bool_or(bad) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM b),
 g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM c JOIN w USING (doc_id, p) GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""
