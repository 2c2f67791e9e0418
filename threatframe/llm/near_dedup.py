"""Operator 6: near-duplicates by DartMinHash signatures and banded joins.

A text is its set (or multiset) of five-word shingles. DartMinHash (Christiani 2020) throws darts, by hashing, at the
region weight x rank of each element, so that about k ln k + 2k of them lie under a text's weights; each of k
coordinates keeps its dart of least rank. Two texts keep the same dart with the probability of their weighted Jaccard
similarity. Runs of ROWS coordinates are band keys; texts that share one are candidates.

Texts of equal words are one class from the start. A bucket links its members to its most popular member, the centre, not
to each other; links are verified exactly on the shingle sets. Where a bucket's members are still in different
components, members outside the centre's component are held against the bucket's members of other components, a block
at a time (4, 64, 1024, ...). Exact upper bounds, from what each has in common with the centre and a bitmap of the
rest, leave only the few pairs that can be similar enough; those are verified like the others. No pair of a bucket that
could join two components stays untested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatframe.llm.common import IDENTITY, SMALL_SLICE, WORDS_SQL, identified, joined, mix, range_hash, raw_text, read, released, run_sql, slices, small_batches, staged, unnamed, with_texts, Words
from threatframe.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 80
ROWS = 4  #: of a band; 20 bands miss a pair of similarity 0.8 once in 38,000
BITMAP = 16  #: longs of the bitmap of shingles outside the centre
_SHINGLE_BASE = np.uint64(0xA0761D6478BD642F)
_FINE = np.array([0, 1 / 64, 1 / 16, 1 / 4, 1])  #: rank slabs below 1; from there on they are one wide


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle; a text of fewer words is one shingle."""
    h = w.hashes()
    start = np.arange(len(w))
    short = (w.count[w.doc] < size) & (start == w.first[w.doc])
    use = short | (start + size <= w.first[w.doc + 1])
    start = start[use]
    doc = w.doc[start]
    return doc, range_hash(h, start, np.minimum(start + size, w.first[doc + 1]), _SHINGLE_BASE)


def _slab(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper rank of slab s = 0, 1, ..."""
    fine = len(_FINE) - 1
    lo = np.where(s < fine, _FINE[np.minimum(s, fine - 1)], s - fine + 1.0)
    hi = np.where(s < fine, _FINE[np.minimum(s, fine - 1) + 1], s - fine + 2.0)
    return lo, hi


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int = COORDINATES) -> np.ndarray:
    """(n_docs, k) signatures of weighted sets given as (doc, element, weight) rows; rows of 0 for empty sets.

    Equal elements of a text must have equal weights (repeating one changes nothing but the first estimate of the
    text's total weight).
    """
    out = np.zeros((n_docs, k), np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    todo = total > 0
    aim = (k * np.log(k) + 2 * k) / np.where(todo, total, 1)  # the rank under which enough darts lie
    first = True
    while todo.any():
        pick = todo[doc]
        d, e, wt = doc[pick], element[pick], weight[pick]
        if not first:  # the few texts with an empty coordinate: distinct elements, their true weight, a higher rank
            order = np.lexsort((e, d))
            d, e, wt = d[order], e[order], wt[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1])
            d, e, wt = d[new], e[new], wt[new]
            true = np.bincount(d, weights=wt, minlength=n_docs)
            aim = np.maximum(aim, (k * np.log(k) + 2 * k) / np.where(true > 0, true, 1) / 2) * 2
        fine = len(_FINE) - 1
        slabs = np.where(aim <= 1, np.searchsorted(_FINE, np.minimum(aim, 1), side="left"), fine - 1 + np.ceil(aim)).astype(np.int64)
        units = np.maximum(1, np.ceil(wt)).astype(np.int64)
        cells = units * slabs[d]
        row = np.repeat(np.arange(len(d)), cells)
        at = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        s, unit = at % slabs[d[row]], at // slabs[d[row]]
        h = mix(e[row] + mix((unit * 1_000_003 + s + 1).astype(np.uint64)))
        lo, hi = _slab(s)
        u = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        area = hi - lo
        term = np.exp(-area)
        live = np.flatnonzero(u >= term)
        row, unit, h, lo, area, u, term = row[live], unit[live], h[live], lo[live], area[live], u[live], term[live]
        darts, cdf, m = np.ones(len(row), np.int64), term.copy(), 1
        while True:  # Poisson counts by inversion
            term = term * area / m
            cdf = cdf + term
            more = u >= cdf
            if not more.any() or m > 12:
                break
            darts += more
            m += 1
        j = np.repeat(np.arange(len(row)), darts)
        nth = np.arange(len(j)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(h[j] + mix(nth.astype(np.uint64) + np.uint64(0x51ED270B)))
        unit_part = lambda x: (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        inside = unit[j] + unit_part(mix(dart + np.uint64(1))) < wt[row[j]]
        j, dart = j[inside], dart[inside]
        rank = lo[j] + area[j] * unit_part(mix(dart + np.uint64(2)))
        key = d[row[j]] * k + (mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, key))
        key, dart = key[order], dart[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        full = np.bincount(key[new] // k, minlength=n_docs) == k
        got = full[key[new] // k]
        out.ravel()[key[new][got]] = dart[new][got]
        todo &= ~full
        first = False
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) hashes of runs of coordinates."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    h = np.broadcast_to(mix(np.arange(1, k // rows + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(rows):
        h = mix(h + parts[:, :, j])
    return h


def _digest(words: bytes) -> bytes:
    return hashlib.md5(words).digest()


def _signed(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SMALL_SLICE):
            w = Words(*raw_text(batch.column(1)))
            digests = [_digest(t) for t in joined(w)]
            doc, element = shingles(w)
            weight = np.ones(len(doc))
            if weighted:  # a shingle weighs as often as the text holds it
                order = np.lexsort((element, doc))
                doc, element = doc[order], element[order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (element[1:] != element[:-1]))[: len(doc)])
                weight = np.diff(np.append(first, len(doc))).astype(float)
                doc, element = doc[first], element[first]
            keys = band_keys(dart_minhash(doc, element, weight, batch.num_rows))
            bands = keys.shape[1] * (w.count > 0)
            offs = np.concatenate(([0], np.cumsum(bands))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(keys[w.count > 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), lists], ["doc_id", "digest", "keys"])

    return run


def _digested(column: str = "text"):
    """Adds `digest`, of the words of a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            w = Words(*raw_text(batch.column(batch.schema.get_field_index(column))))
            digests = [_digest(t) for t in joined(w)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, "digest"])

    return run


def _sets(weighted: bool):
    """(node, text) -> (node, different shingles). With weights, the second and later occurrences of a shingle are
    elements of their own, so that the Jaccard similarity of these sets is that of the multisets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SMALL_SLICE):
            w = Words(*raw_text(batch.column(1)))
            doc, h = shingles(w)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            if weighted:
                first = np.flatnonzero(new)
                nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
                h, new = np.where(nth > 0, mix(h + mix(nth.astype(np.uint64))), h), np.ones(len(h), bool)
            offs = np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=batch.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(h[new].view(np.int64)))], ["node", "shingles"])

    return run


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(centre, node, their shingles) -> exact Jaccard similarity, common shingles, the node's size, and a bitmap of the
    node's shingles that the centre lacks."""
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        nx, ny = (np.diff(np.asarray(c.offsets)) for c in (x, y))
        own = np.asarray(y.flatten()).view(np.uint64)
        of_own = np.repeat(np.arange(batch.num_rows), ny)
        salt = mix(np.arange(1, batch.num_rows + 1, dtype=np.uint64))
        theirs = np.asarray(x.flatten()).view(np.uint64) ^ np.repeat(salt, nx)
        common = np.isin(own ^ salt[of_own], theirs)
        same = np.bincount(of_own[common], minlength=batch.num_rows)
        bits = np.zeros((batch.num_rows, 64 * BITMAP), np.uint8)
        bits[of_own[~common], (mix(own[~common]) % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
        bits = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        long = lambda v: pa.array(v.astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(same / np.maximum(nx + ny - same, 1)), long(same), long(ny), *(pa.array(bits[:, k]) for k in range(BITMAP))],
            ["centre", "node", "sim", "common", "size", *(f"b{k}" for k in range(BITMAP))],
        )


COMPARED = "centre long, node long, sim double, common long, size long, " + ", ".join(f"b{k} long" for k in range(BITMAP))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("centre"), F.col("shingles").alias("sa"))
    right = sets.select("node", F.col("shingles").alias("sb"))
    both = pairs.join(left, "centre").join(right, "node").select("centre", "node", "sa", "sb")
    return staged(both.mapInArrow(released(_similarities), COMPARED), "compared")


def _can_link(threshold: float):
    """Whether members x and y of a bucket can be similar enough, from what each has in common with the centre: at most
    the smaller of the two common parts, and those shingles outside the centre whose bits both have."""
    missing = lambda a, b: sum((F.bit_count(F.col(f"{a}_b{k}").bitwiseAND(F.bitwise_not(f"{b}_b{k}"))) for k in range(BITMAP)), F.lit(0))
    extra = F.least(F.col("x_size") - F.col("x_common") - missing("x", "y"), F.col("y_size") - F.col("y_common") - missing("y", "x"))
    most = F.least("x_common", "y_common")
    sizes = F.col("x_size") + F.col("y_size")
    whole = F.least(F.col("x_size") - F.col("x_common"), F.col("y_size") - F.col("y_common"))
    reach = lambda common: common * (1 + threshold) >= (threshold - 1e-9) * sizes
    near = F.abs(F.col("x_sim") - F.col("y_sim")) <= 1 - threshold + 1e-9  # Jaccard distance is a metric
    return near & reach(most + whole) & reach(most + extra)


def _stars(groups: DataFrame) -> DataFrame:
    """(key, node) -> (key, node, centre) of groups of two or more; the node in the most and largest groups is the
    centre: a text that copies were made from shares most with them."""
    sizes = staged(groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = staged(groups.join(sizes, "key"), "members")
    popular = staged(members.groupBy("node").agg(F.sum("n").alias("pop")), "popular")
    members = staged(members.drop("n").join(popular, "node"), "members")
    best = F.max(F.struct("pop", (-F.col("node")).alias("late")))
    centres = staged(members.groupBy("key").agg((-best["late"]).alias("centre")), "centres")
    return staged(members.join(centres, "key").select("key", "node", "centre"), "members")


def _labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Adds a node's component; a node without links is its own."""
    out = df.join(labels.select(F.col("node").alias(node), F.col("label").alias(name)), node, "left")
    return out.withColumn(name, F.coalesce(name, node))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of the components that these links join."""
    ends = _labelled(_labelled(links, labels, "a", "la"), labels, "b", "lb")
    moved = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    moved = staged(moved.select(F.col("node").alias("label"), F.col("label").alias("_new")), "moved")
    lone = moved.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), "label")
    out = labels.union(lone).join(moved, "label", "left")
    return staged(out.select("node", F.coalesce("_new", "label").alias("label")), "labels")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of doc_id and digest; classes of digest, class_id, keep_digest, keep_id, class_size).

    weighted: a shingle weighs as often as the text holds it, in signatures and in the exact similarity (weighted Jaccard);
    otherwise texts are sets of shingles.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(texts.mapInArrow(released(_signed(weighted)), "doc_id long, digest binary, keys array<long>"), "signed")
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "texts")
    banded = classes.select("node", F.explode("keys").alias("key"))
    members = _stars(banded)

    # The shingle sets of all members, from one text of each class.
    wanted = identified(classes.join(members.select("node").distinct(), "node"), "rep").select("node", *IDENTITY)
    found = with_texts(staged(wanted, "wanted"), texts, _digest).select("node", "text")
    sets = staged(found.mapInArrow(released(_sets(weighted)), "node long, shingles array<long>"), "sets")

    enough = F.col("sim") >= threshold - 1e-9
    compared = _compared(members.filter("node <> centre").select("centre", "node").distinct(), sets)
    links = lambda c: c.filter(enough).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    labels = staged(components(links(compared)), "labels")
    outside, block = members.filter("node <> centre"), 0
    while True:
        outside = _labelled(_labelled(outside, labels, "node", "own"), labels, "centre", "main").filter("own <> main")
        nth = F.row_number().over(Window.partitionBy("key").orderBy("node"))
        outside = staged(outside.select("key", "node", "centre", nth.alias("nth")), "outside")
        if outside.isEmpty():
            break
        block = 16 * block or 4
        facts = lambda m, k: _labelled(m.join(compared, ["centre", "node"]), labels, "node", "own").select("key", *(F.col(c).alias(f"{k}_{c}") for c in ("node", "own", *compared.columns[2:])))
        x = facts(outside.filter(F.col("nth") <= block).drop("nth"), "x")
        y = facts(members.filter("node <> centre").join(outside.select("key").distinct(), "key"), "y")
        pairs = x.join(y, "key").filter((F.col("x_own") != F.col("y_own")) & _can_link(threshold))
        pairs = pairs.select(F.least("x_node", "y_node").alias("centre"), F.greatest("x_node", "y_node").alias("node")).distinct()
        more = links(_compared(staged(pairs, "pairs"), sets))
        if not more.isEmpty():
            labels = _merged(labels, more)
        outside = outside.filter(F.col("nth") > block).drop("nth")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest"))
    named = _labelled(classes.drop("keys"), labels, "node", "label")
    heads = named.groupBy("label").agg(first.alias("head"), F.sum("copies").alias("class_size"))
    facts = named.join(staged(heads, "heads"), "label").select(
        "digest", F.col("head.rep").alias("class_id"), F.col("head.digest").alias("keep_digest"), F.col("head.rep").alias("keep_id"), "class_size"
    )
    return rows, staged(facts, "classes")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """doc_id, class_id, class_size, kept: one row per document.

    class_id is the least doc_id of the class (null where none has one); the row with it is kept. Texts without words
    are one class of equal texts; texts of one to four words are one shingle. Rows that repeat the kept doc_id and its
    words are all marked kept; `keep_near` leaves one of them. Very long texts are compared whole, other columns are
    ignored. No rows give no rows.
    """
    rows, facts = near_classes(docs, threshold, weighted)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest"))
    return rows.select("doc_id", "digest").join(facts, "digest").select("doc_id", "class_id", "class_size", kept.alias("kept"))


def keep_near(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each near-duplicate class, all columns kept, whatever they are called.

    The one with the class's least doc_id stays (of a class without any, one of the rows); of rows that repeat it, one.
    Null texts and texts without words are one class of equal texts. Very long texts are compared whole. No rows give no
    rows.
    """
    _, facts = near_classes(docs, threshold)
    plain, names, back = unnamed(docs)
    heads = identified(facts.select(F.col("keep_digest").alias("digest"), "keep_id").distinct(), "keep_id").select(*IDENTITY)
    plain = plain.withColumn(names["text"], F.col(names["text"]).cast("string"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    full = identified(plain.mapInArrow(released(_digested(names["text"])), f"{schema}, digest binary"), names["doc_id"]).join(heads, IDENTITY)
    first = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy(*IDENTITY))
    return back(full.withColumn("nth", first).filter("nth = 1"))


def op6_dart_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))


#: The contract in SQL: components of pairs whose shingle sets have a Jaccard similarity of 0.8; texts without words are one class.
OP6_SQL = f"""{WORDS_SQL.replace("WITH d AS", "WITH RECURSIVE d AS", 1)}, s AS MATERIALIZED (SELECT DISTINCT doc_id, h FROM ({run_sql(SHINGLE)}) WHERE h IS NOT NULL
  UNION SELECT doc_id, md5(string_agg(word, ' ' ORDER BY p)) FROM w GROUP BY doc_id HAVING count(*) < {SHINGLE}),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c) - 1e-9 UNION SELECT (SELECT min(doc_id) FROM d WHERE len(words) = 0), doc_id FROM d WHERE len(words) = 0),
 k AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT doc_id, doc_id FROM d), reach AS (SELECT a AS root, b AS node FROM k UNION SELECT r.root, k.b FROM reach r JOIN k ON k.a = r.node),
 m AS (SELECT root AS doc_id, min(node) AS class_id, count(*) AS class_size FROM reach GROUP BY root)
 SELECT doc_id, class_id, class_size, doc_id = class_id AS kept FROM m"""
