import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tests.llm.helpers import CLASH, docs_of, empty, odd, rows_of, words
from threatframe.llm import exact_dedup, mixing, packing, sharding


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_exact_dedup_equals_brute_force(spark, sf, table):
    docs = odd(spark) if table == "odd" else docs_of(spark, sf)
    got = exact_dedup.exact_dedup(docs).collect()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for r in rows_of(docs):
        groups[hashlib.sha256(low(r["text"]).encode()).hexdigest()].append(r["doc_id"])
    assert len(got) == docs.count()
    kept = Counter()
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    stays = exact_dedup.keep_one(docs)
    assert stays.columns == docs.columns and stays.count() == len(groups)
    assert table == "sf" or {c for r in stays.select(*CLASH).collect() for c in r} == {"clash"}


def test_cuckoo_index_inserts_deletes_and_grows():
    index = exact_dedup.CuckooIndex(capacity=8, fingerprint_bits=6)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert index.live == 3000 and index.resizes > 0 and index.false_hits > 0
    assert [index.get(k) for k in keys] == list(range(3000))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.get(k) for k in keys] == [None if i % 2 == 0 else i for i in range(3000)]
    index.insert(keys[1], "new")
    assert index.get(keys[1]) == "new" and index.live == 1500


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_shards_match_the_mixture(spark, sf, table):
    docs = odd(spark) if table == "odd" else docs_of(spark, sf)
    got = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows_of(docs)
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert got[0].law == "rows" and got[0].grown_shard is None
    again = sharding.shard_documents(docs.repartition(3)).collect()
    assert Counter(got) == Counter(again)


def test_every_shard_holds_each_source_in_its_share(spark, sf):
    rows = docs_of(spark, sf).select("doc_id", "source")
    n = rows.count()
    got = sharding.interleave(rows, n).groupBy("source", "shard").count().collect()
    by = defaultdict(lambda: [0] * 16)
    for r in got:
        by[r.source][r.shard] = r["count"]
    assert all(max(v) - min(v) <= 2 for v in by.values())


def test_word_encoder_equals_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    full = Tokenizer.from_file(path)
    texts = [r["text"] for r in rows_of(odd(spark)) + rows_of(docs_of(spark, sf))]
    ids, offs = packing.WordEncoder(path).texts(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == [*full.encode(t or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_packing_is_whole_and_tight(spark, sf, table):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.tokenizer_path())
    docs = odd(spark) if table == "odd" else docs_of(spark, sf)
    got = packing.pack_documents(docs, packing.tokenizer_path()).collect()
    want = Counter()
    for r in rows_of(docs):
        ids = [*full.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[r["doc_id"], piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 4096 + 1


def test_two_shorter_pieces_replace_the_smallest():
    # Greedy takes 6 and 3 and leaves 1; 2 + 2 fill the gap of 4 that 3 leaves.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [(1, [(6, 1), (2, 2)]), (1, [(3, 1)])]
    bins = packing.best_two_fit({7: 10**12, 3: 10**12, 1: 5}, 10)
    assert sum(t for t, _ in bins) == 10**12 + 1


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_mix_meets_its_targets(spark, sf, table):
    docs = odd(spark) if table == "odd" else docs_of(spark, sf)
    got = mixing.mix_documents(docs).collect()
    rows = rows_of(docs)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r["doc_id"], len(words(r["text"]))) for r in rows)
    size = Counter()
    for r in rows:
        size[r["source"]] += len(words(r["text"]))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s] + 1e-9}
        for s in full or open_:
            target[s] = 2.0 * size[s] if full else weight[s] * level
            left -= target[s] if full else 0
        open_ -= full or open_
    of = {r["doc_id"]: r["source"] for r in rows}
    taken, most = Counter(), Counter()
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in size)
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in got)
    assert table == "sf" or {c for r in mix.select(*CLASH).collect() for c in r} == {"clash"}
    assert all(r.copies == 0 for r in got if r.size == 0)


def test_rounding_keeps_the_expected_copies_of_each_document():
    """Mean copies over many seeds, through two levels of the tree and the last flip."""
    share = [0.65, 0.35, 0.5, 0.2, 0.8, 0.29, 0.71, 0.4, 0.6]
    size = [3, 8, 5, 13, 2, 7, 4, 9, 6]
    seeds, total = 3000, [0.0] * 9
    schema = pa.schema([("row", pa.int64()), ("s", pa.int64()), ("bucket", pa.int64()), ("h", pa.int64()), ("size", pa.int64()), ("p", pa.float64())])
    for seed in range(seeds):
        rows = [[k, 1, k % 3, 1000 * seed + k, size[k], share[k]] for k in range(9)]
        rows.sort(key=lambda r: r[2])
        done = []
        for level, last in ((0, False), (1, True)):
            out = [r for b in mixing._pair_up(seed, level, last)(iter([mixing._rows(rows, schema)])) for r in map(list, zip(*(c.to_pylist() for c in b.columns), strict=True))]
            done += [r for r in out if r[5] in (0.0, 1.0)]
            rows = [[*r[:2], 0, *r[3:]] for r in out if r[5] not in (0.0, 1.0)]
        assert len(done) == 9 and not rows
        assert abs(sum(r[5] * r[4] for r in done) - sum(p * z for p, z in zip(share, size, strict=True))) < max(size)
        for r in done:
            total[r[0]] += r[5]
    assert all(abs(t / seeds - p) < 3.5 * (p * (1 - p) / seeds) ** 0.5 for t, p in zip(total, share, strict=True))


def test_shards_leave_user_columns_alone(spark):
    docs = odd(spark)
    got = sharding.interleave(docs, docs.count())
    assert got.columns == [*(c for c in docs.columns if c not in ("shard", "slot")), "shard", "slot"]
    assert {c for r in got.select(*(c for c in CLASH if c not in ("shard", "slot"))).collect() for c in r} == {"clash"}


def test_empty_tables(spark):
    docs = empty(spark)
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert exact_dedup.keep_one(docs).count() == 0
    assert sharding.shard_documents(docs).count() == 0
    assert packing.pack_documents(docs, packing.tokenizer_path()).count() == 0
    assert mixing.mix_documents(docs).count() == 0
    assert mixing.mixed(docs).count() == 0
