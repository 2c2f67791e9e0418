"""Operator 3: quality rules with suffix-array repetition.

Words of a text form an integer string. A suffix array over it (prefix doubling, for all texts of a slice at once) and
the common prefixes of its neighbours give, for each position, the longest substring that starts there and occurs
elsewhere in the text: the ends of the LCP intervals are the maximal repeated substrings. Their spans are united, and
the rule limits the covered share of the words and the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.llm.common import SPACE, WORDS_SQL, mix, per_text, raw_text, read, released, run_sql, slices, small_batches, Words

MIN_WORDS = 10
WINDOW = 5
WINDOW_PERCENT = 20
LONG_REPEAT = 15  #: words from which a repeated substring counts for the covered share
COVERED_PERCENT = 15
LONGEST = 120  #: words that the longest repeat may have

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


def longest_repeats(code: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position of many concatenated texts, the length of the longest substring that starts there and also
    starts elsewhere in the same text. doc: the position's text; end: where that text ends."""
    n = len(code)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    key = mix(code + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    group = np.flatnonzero(new)
    size = np.diff(np.append(group, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(group, size)
    levels = [rank.astype(np.int32)]
    active, h = order[np.repeat(size > 1, size)], 1
    suspects = np.sort(active)  # only their first word occurs twice
    if not len(suspects):
        return longest
    while len(active):
        after = active + h
        second = np.where(after < end[active], rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[active] * (n + 2) + second
        o = np.argsort(both, kind="stable")
        active, both = active[o], both[o]
        old = rank[active]
        starts = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        size = np.diff(np.append(starts, len(both)))
        olds = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        origin = np.repeat(olds, np.diff(np.append(olds, len(old))))
        rank[active] = old + np.repeat(starts, size) - origin
        levels.append(rank.astype(np.int32))
        active = active[np.repeat(size > 1, size)]
        h *= 2
    place = np.argsort(rank[suspects], kind="stable")
    suffix = suspects[place]  # the suffix array, as far as neighbours can share a word
    a, b, shared = suffix[:-1], suffix[1:], np.zeros(len(suffix) - 1, np.int64)
    for t in range(len(levels) - 1, -1, -1):
        i, j = a + shared, b + shared
        inside = (i < end[a]) & (j < end[b])
        level = levels[t]
        same = inside & (level[np.minimum(i, n - 1)] == level[np.minimum(j, n - 1)])
        shared += same.astype(np.int64) << t
    longest[a] = shared
    longest[b] = np.maximum(longest[b], shared)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions the united spans of repeats of at least `least` words cover."""
    at = np.flatnonzero(longest >= least)
    step = np.zeros(len(longest) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + longest[at], -1)
    return np.cumsum(step[:-1]) > 0


def _text_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        names = batch.schema.names
        arr = batch.column(names.index("text"))
        w = Words(*raw_text(arr))
        n_docs = batch.num_rows
        word_chars = per_text(((w.raw & 0xC0) != 0x80) & ~SPACE[w.raw], w.offs)
        symbols = per_text(_SYMBOL[w.raw], w.offs)
        longest = longest_repeats(w.hashes(), w.doc, np.repeat(w.first[1:], w.count))
        repeat_words = per_text(covered(longest, WINDOW), w.first)
        long_words = per_text(covered(longest, LONG_REPEAT), w.first)
        top = np.zeros(n_docs, np.int64)
        np.maximum.at(top, w.doc, longest)
        lines = pc.split_pattern(arr.fill_null(""), "\n")
        of = np.repeat(np.arange(n_docs), np.diff(np.asarray(lines.offsets)))
        coded = lines.flatten().dictionary_encode()
        has_word = np.asarray(pc.greater(pc.utf8_length(pc.ascii_trim_whitespace(coded.dictionary)), 0))
        codes = np.asarray(coded.indices)
        with_word = has_word[codes] if len(codes) else np.zeros(0, bool)
        pairs = of[with_word] * (len(coded.dictionary) + 1) + codes[with_word]
        total = np.bincount(of[with_word], minlength=n_docs)
        distinct = np.bincount(np.unique(pairs) // (len(coded.dictionary) + 1), minlength=n_docs)
        long = pa.int64()
        keep = [k for k, f in enumerate(names) if f != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), *(pa.array(x, long) for x in (w.count, word_chars, symbols, total - distinct, repeat_words, long_words, top))],
            [*(names[k] for k in keep), *FACTS],
        )


FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_long_repeat_words", "longest_repeat"]


def verdicts(facts: DataFrame) -> DataFrame:
    """Adds base_failed and kept to rows of FACTS."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > WINDOW_PERCENT * F.col("n_words"))
    good = (100 * F.col("n_long_repeat_words") <= COVERED_PERCENT * F.col("n_words")) & (F.col("longest_repeat") <= LONGEST)
    return facts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_long_repeat_words, longest_repeat,
    base_failed, kept: one row per document (null texts have no words and fail; repeated rows are judged alike)."""
    small_batches(docs.sparkSession)
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(_text_facts), "doc_id long, " + ", ".join(f"{c} long" for c in FACTS))
    return verdicts(facts)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches without the rows that the rules reject."""
    for batch in slices(batches):
        text = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))], ["text"])
        facts = pa.Table.from_batches(list(_text_facts(iter([text]))))
        n, rep, long, top = (np.asarray(facts[c]) for c in ("n_words", "n_repeat_words", "n_long_repeat_words", "longest_repeat"))
        ok = (n >= MIN_WORDS) & (100 * rep <= WINDOW_PERCENT * n) & (100 * long <= COVERED_PERCENT * n) & (top <= LONGEST)
        yield batch.filter(pa.array(ok))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns, whatever they are called.

    Null texts and texts without words are rejected; repeated rows are judged alike; very long texts are judged whole. No
    rows give no rows.
    """
    small_batches(docs.sparkSession)
    return docs.mapInArrow(released(_judged), docs.schema)


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).drop("longest_repeat")


def _covered_sql(words: int) -> str:
    """doc_id, n: words in a run of so many words that the text holds twice."""
    return f"""(SELECT doc_id, count(*) FILTER (hit) AS n FROM (SELECT doc_id, bool_or(c > 1) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {words - 1} PRECEDING AND CURRENT ROW) AS hit
 FROM (SELECT doc_id, p, CASE WHEN h IS NOT NULL THEN count(*) OVER (PARTITION BY doc_id, h) ELSE 0 END AS c FROM ({run_sql(words)}))) GROUP BY doc_id)"""


#: The contract in SQL: spans of repeats of n words or more are the runs of n words found twice, and the longest repeat is
#: over the limit where a run of one word more is found twice.
OP3_SQL = f"""{WORDS_SQL}, n AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY doc_id),
 l AS (SELECT doc_id, unnest(string_split(text, '\n')) AS line FROM d), u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
 f AS (SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_words, CAST(coalesce(n.chars, 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines,
  coalesce(a.n, 0) AS n_repeat_words, coalesce(b.n, 0) AS n_long_repeat_words, coalesce(c.n, 0) AS over
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN {_covered_sql(WINDOW)} a USING (doc_id) LEFT JOIN {_covered_sql(LONG_REPEAT)} b USING (doc_id) LEFT JOIN {_covered_sql(LONGEST + 1)} c USING (doc_id)),
 v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {WINDOW_PERCENT} * n_words AS base_failed FROM f)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_long_repeat_words, base_failed, NOT base_failed AND 100 * n_long_repeat_words <= {COVERED_PERCENT} * n_words AND over = 0 AS kept FROM v"""
