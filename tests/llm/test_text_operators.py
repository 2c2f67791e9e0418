import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import CLASH, docs_of, empty, odd, rows_of, words
from threatframe.llm import common, components, near_dedup, quality_rules, substring_dedup


def brute_substrings(rows, win=50):
    first, texts = {}, [(r["doc_id"], words(r["text"])) for r in rows]
    for i, w in texts:
        for p in range(len(w) - win + 1 if i is not None else 0):
            k = tuple(w[p : p + win])
            first[k] = min(first.get(k, i), i)
    out = Counter()
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - win + 1):
            f = first.get(tuple(w[p : p + win]))
            if f is not None and (i is None or f < i):
                gone[p : p + win] = [True] * win
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_substring_dedup_equals_brute_force(spark, sf, table):
    docs = odd(spark) if table == "odd" else docs_of(spark, sf)
    assert Counter(map(tuple, substring_dedup.substring_dedup(docs).collect())) == brute_substrings(rows_of(docs))


def test_sketch_never_underestimates(spark):
    lists = [[1, 2, 3], [3, 4], [5, 6, 1], [7]]
    rows = spark.createDataFrame([(bytes([k]), a) for k, a in enumerate(lists)], "digest binary, anchors array<long>").repartition(3)
    got = {bytes(r.digest)[0]: set(r.anchors) for r in substring_dedup.estimated_repeated(rows).collect()}
    assert {1, 3} <= got[0] and 3 in got[1] and 1 in got[2]


def near_classes(rows, threshold=0.8, weighted=False):
    sets = []
    for r in rows:
        w = words(r["text"])
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        seen = Counter()
        for k, g in enumerate(grams):
            grams[k] = (g, seen[g] * weighted)
            seen[g] += 1
        sets.append(frozenset(grams))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s or [()]:
            holders[g].append(i)
    for a, b in {(x, y) for h in holders.values() for k, y in enumerate(h) for x in h[:k]}:
        both = len(sets[a] | sets[b])
        if not both or len(sets[a] & sets[b]) >= threshold * both - 1e-9:
            parent[find(a)] = find(b)
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[find(i)].append(r["doc_id"])
    return Counter((r["doc_id"], min((x for x in classes[find(i)] if x is not None), default=None), len(classes[find(i)])) for i, r in enumerate(rows))


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_near_dedup_equals_brute_force(spark, sf, table):
    docs = odd(spark) if table == "odd" else docs_of(spark, sf)
    got = near_dedup.near_dedup(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == near_classes(rows_of(docs))
    stays = near_dedup.keep_near(docs)
    assert stays.columns == docs.columns
    assert table == "sf" or {c for r in stays.select(*CLASH).collect() for c in r} == {"clash"}
    assert stays.count() == len({(r.class_id, r.class_size) if r.class_id is not None else "none" for r in got})


@pytest.mark.parametrize("weighted", [False, True])
def test_weights_tell_repeated_passages_apart(spark, weighted):
    """As sets, a text equals itself with a passage repeated; as weighted sets it does not."""
    part = " ".join(f"a{i}" for i in range(40))
    texts = [part + " " + " ".join([part] * k) for k in (1, 1, 2, 6, 7, 8)] + [part, part + " end"]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = near_dedup.near_dedup(docs, weighted=weighted).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == near_classes(rows_of(docs), weighted=weighted)


def test_texts_come_through_the_bloom_filter(spark):
    texts = spark.createDataFrame([(k if k % 7 else None, f"w{k % 50} x  y{k}") for k in range(700)] * 2, "doc_id long, text string")
    digest = lambda t: hashlib.md5(t).digest()
    rows = [(k, digest(f"w{k % 50} x y{k}".encode()), k if k % 7 else 0, k % 7 == 0) for k in range(0, 700, 3)]
    wanted = spark.createDataFrame(rows, "node long, digest binary, id long, none boolean")
    got = Counter((r.node, r.text) for r in common.with_texts(wanted, texts, digest).collect())
    assert got == Counter((k, f"w{k % 50} x  y{k}") for k in range(0, 700, 3))


def test_chain_of_near_copies_is_one_class(spark):
    """Each text is close to the next only: stars alone would lose links."""
    base = [f"t{i}" for i in range(120)]
    texts, now = [], list(base)
    for k in range(25):
        texts.append((k, " ".join(now), "en", "s", 1))
        for j in range(4):
            now[(k * 4 + j) % 120] = f"new{k}"
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    got = near_dedup.near_dedup(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == near_classes(rows_of(docs))


def test_labels_merge_with_more_links(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, label long")
    links = spark.createDataFrame([(2, 6), (9, 20), (30, 31)], "a long, b long")
    got = {r.node: r.label for r in near_dedup._merged(labels, links).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 8, 30: 30, 31: 30}


def test_copies_around_a_lost_centre(spark):
    """Copies of a text with random edits: many are too far from the least of them, but close to one another."""
    r = np.random.default_rng(5)
    base = [f"t{i}" for i in range(150)]
    texts = []
    for k in range(60):
        now = list(base)
        for p in r.integers(0, 150, 4 if k else 6):
            now[p] = f"e{k}x{p}"
        texts.append((k, " ".join(now), "en", "s", 1))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    got = near_dedup.near_dedup(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == near_classes(rows_of(docs))


@pytest.mark.parametrize("kind", ["set", "weights"])
def test_dart_minhash_estimates_weighted_jaccard(kind):
    r = np.random.default_rng(0)
    element = r.integers(0, 2**63, 300).astype(np.uint64)
    a = np.ones(300) if kind == "set" else r.integers(1, 6, 300).astype(float)
    b = a.copy()
    b[:90] = 0.4 if kind == "set" else r.random(90) * 4 + 0.1
    s = near_dedup.dart_minhash(np.repeat([0, 1], 300), np.tile(element, 2), np.concatenate([a, b]), 2, 3000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 300)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 300)}


def brute_repeats(w):
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            if i != j:
                n = 0
                while i + n < len(w) and j + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                out[i] = max(out[i], n)
    return out


def test_suffix_array_finds_the_longest_repeats():
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice(list("abc"), int(n))) for n in r.integers(0, 60, 30)] + ["x " * 33, "a b c d a b c d a b", ""]
    w = common.words_of(pa.array(texts))
    got = quality_rules.longest_repeats(w.hashes(), w.doc, np.repeat(w.first[1:], w.count))
    assert got.tolist() == [n for t in texts for n in brute_repeats(words(t))]


def brute_facts(text):
    w, seen, dups = words(text), set(), 0
    marked = [False] * len(w)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            marked[i : i + 5] = [True] * 5
    for line in (text or "").split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * sum(marked) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dups, sum(marked), failed


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_quality_rules_equal_brute_force(spark, sf, table):
    docs = odd(spark) if table == "odd" else docs_of(spark, sf)
    got = quality_rules.quality_rules(docs).collect()
    want = Counter((r["doc_id"], *brute_facts(r["text"])) for r in rows_of(docs))
    texts = {r["doc_id"]: words(r["text"]) for r in rows_of(docs)}
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    for r in got:  # the method's own columns, where the quadratic form is quick enough
        w = texts[r.doc_id]
        if len(w) <= 250:
            longest = brute_repeats(w)
            marked = [False] * len(w)
            for i, n in enumerate(longest):
                if n >= 15:
                    marked[i : i + n] = [True] * n
            assert (r.n_long_repeat_words, r.longest_repeat) == (sum(marked), max(longest, default=0))
            assert r.kept == (not r.base_failed and 100 * sum(marked) <= 15 * len(w) and max(longest, default=0) <= 120)
    assert all(not (r.base_failed and r.kept) for r in got)
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r.kept for r in got)


def test_long_repeats_reject(spark):
    once = " ".join(f"u{i}" for i in range(400))
    passage = " ".join(f"v{i}" for i in range(30))
    rows = [(1, once, "en", "s", 1), (2, f"{once} {passage} {once[:900]}", "en", "s", 1), (3, f"{once} {passage} mid {passage}", "en", "s", 1)]
    got = {r.doc_id: (r.kept, r.longest_repeat) for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[1] == (True, 0) and not got[2][0] and got[2][1] > 120 and got[3] == (True, 30)


def test_empty_tables(spark):
    docs = empty(spark)
    assert substring_dedup.substring_dedup(docs).count() == 0
    assert near_dedup.near_dedup(docs).count() == 0
    assert near_dedup.keep_near(docs).count() == 0
    assert quality_rules.quality_rules(docs).count() == 0
    assert quality_rules.keep_good(docs).count() == 0


def test_word_offsets_over_text_borders():
    arr = pa.array(["a b", "c", None, "", " d\x0be ", "f"]).slice(1)
    w = common.words_of(arr)
    assert [w.text(i) for i in range(len(w))] == [b"c", b"d", b"e", b"f"] and w.count.tolist() == [1, 0, 0, 2, 1]


def test_ranks_are_exact(spark):
    df = spark.range(1000).withColumns({"k": F.when(F.col("id") % 3 == 0, "a").otherwise("b"), "h": F.xxhash64("id")})
    got = common.ranked(df, ["k"], F.pmod(F.shiftright("h", 40), F.lit(1)) + F.shiftright("h", 55), [F.col("h")]).collect()
    for k in "ab":
        own = sorted((r for r in got if r.k == k), key=lambda r: r.h)
        assert [r["rank"] for r in own] == list(range(len(own))) and {r.key_rows for r in own} == {len(own)}
