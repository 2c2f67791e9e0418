import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import ODD, docs_of, empty, odd, words
from threatframe.llm import labelled, langid, quality_model, toxicity

SF = "/root/testdata/sf0.01"


def truth(spark, sf, table, column):
    return {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/{table}.parquet").collect()}


def test_language_of_held_out_texts(spark):
    got = langid.op8_byte_convnet_langid(spark, SF).collect()
    lang = truth(spark, SF, "documents", "lang")
    held = [r for r in got if r.held_out]
    assert len(got) == docs_of(spark, SF).count() and 0.2 < len(held) / len(got) < 0.3
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held if lang[r.doc_id]]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_of_held_out_texts(spark):
    got = quality_model.op9_nbsvm_quality(spark, SF).collect()
    label = truth(spark, SF, "labels", "quality")
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_of_held_out_texts(spark):
    got = toxicity.op2_boosted_toxicity(spark, SF).collect()
    label = truth(spark, SF, "labels", "toxic")
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


@pytest.mark.parametrize("make", [odd, empty])
def test_models_score_odd_and_empty_tables(spark, make):
    docs = make(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    n = docs.count()
    assert langid.identify(docs, langid.fit(docs)).count() == n
    for fit, score in ((quality_model.fit, quality_model.score_quality), (toxicity.fit, toxicity.score_toxicity)):
        got = score(docs, fit(docs, labels)).collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert not n or (by[3], by[4], by[5]) == ("und", "und", "und")


def test_windows_cover_every_byte():
    raw, offs = np.arange(250, dtype=np.uint8).repeat(3), np.array([0, 0, 10, 266, 750])
    codes, text, have = langid.windows(raw, offs, 256)
    assert have.tolist() == [0, 10, 256, 256, 228] and text.tolist() == [0, 1, 2, 3, 3]
    assert (codes[2] == raw[10:266]).all() and (codes[0] == 256).all()


def test_network_gradients_are_right():
    r = np.random.default_rng(3)
    net = langid.ByteConvNet(["a", "b"])
    for name in ("embed", "kernel", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.mask = net.mask.astype(np.float64)
    codes, y = r.integers(0, 256, (5, 40)).astype(np.int16), np.array([0, 1, 1, 0, 1])
    loss = lambda: -net.log_proba(codes)[np.arange(5), y].mean()
    for p, g in zip([net.embed, net.kernel, net.bias, net.out, net.out_bias], net._gradients(codes, y), strict=True):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[k] += 1e-6
        up = loss()
        p[k] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[k]) < 1e-4
        p[k] += 1e-6


def test_isotonic_fit_never_falls():
    r = np.random.default_rng(2)
    x = r.normal(size=400)
    xs, ys = toxicity.isotonic(x, (x + r.normal(size=400) > 0).astype(float))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and 0 < ys.min() and ys.max() < 1


def test_boosted_trees_learn_an_interaction():
    r = np.random.default_rng(4)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    trees = toxicity.BoostedTrees().fit(x[:1500], y[:1500])
    assert ((trees.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_shape_ngrams_carry_over_to_new_words():
    good = [f"Word{i} other thing{i} here. And more{i}." for i in range(60)]
    bad = [f"w{i}*** x{i}%%% y{i}*** z{i}%%%" for i in range(60)]
    model = quality_model.NbSvm().fit(good + bad, np.array([1] * 60 + [0] * 60))
    s = model.score(pa.array(["Quite fresh words stand here.", "zz*** qq%%% vv*** rr%%%"]))
    assert s[0] > 0.5 > s[1]


def best_isotonic(y):
    """The nondecreasing fit by its max-min formula."""
    n = len(y)
    mean = lambda a, b: sum(y[a : b + 1]) / (b - a + 1)
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_equals_the_max_min_formula():
    r = np.random.default_rng(7)
    x = np.sort(r.normal(size=40))
    y = (x + r.normal(size=40) > 0).astype(float)
    want = best_isotonic([0.0, *y, 1.0])
    size = {v: want.count(v) for v in want}
    xs, ys = toxicity.isotonic(x, y)
    got = np.interp([x[0] - 1, *x, x[-1] + 1], xs, ys)
    assert np.allclose(got, [(v * size[v] + 0.01) / (size[v] + 0.02) for v in want])


def brute_features(text, lexicon):
    """The features of one text, word by word."""
    w = words(text)
    low = [x.lower() for x in w]
    clean = ["".join(c for c in "".join(toxicity.LEET.get(c, c) for c in x) if c.isalpha()) for x in low]
    forms = {"words": clean, "stem5": [c[:5] if len(c) >= 5 else "" for c in clean], "stem4": [c[:4] if len(c) >= 4 else "" for c in clean]}
    hits = {k: [f in set(lexicon.entries[k].to_pylist()) for f in forms[k]] for k in toxicity.LEXICONS}
    second = [x.strip(".,;:!?\"'()") in toxicity.SECOND for x in low]
    odd_ones = [bool(re.search(r"[^\W\d_][0-9@$*!._-]+[^\W\d_]", x)) for x in low]
    anywhere = [any(h) for h in zip(*hits.values(), strict=True)]
    near = [a and any(second[max(0, i - 5) : i] + second[i + 1 : i + 6]) for i, a in enumerate(anywhere)]
    upper = lambda c: "A" <= c <= "Z" or "\u00c0" <= c <= "\u00de"
    letter = lambda c: c.isascii() and c.isalpha() or c >= "\u00c0"
    shout = [sum(map(upper, x)) > 1 and sum(map(upper, x)) == sum(map(letter, x)) for x in w]
    out = []
    for flags in (*hits.values(), anywhere, near, [a and o for a, o in zip(anywhere, odd_ones, strict=True)], second, odd_ones, shout):
        out += [sum(flags) / max(1, len(w)), math.log1p(sum(flags))]
    raw = text.encode()
    punct = set(range(33, 48)) | set(range(58, 65)) | set(range(91, 97)) | set(range(123, 127))
    for n in (sum(map(upper, text)), sum(b in punct for b in raw), raw.count(b"!"), raw.count(b"?"), sum(48 <= b <= 57 for b in raw), sum(raw.count(m) for m in (b"*", b"@", b"$"))):
        out.append(n / max(1, len(raw)))
    return [*out, math.log1p(len(w)), sum(len(x.encode()) for x in w) / max(1, len(w))]


def test_toxicity_scores_equal_a_word_by_word_version(spark):
    docs = docs_of(spark, SF)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    some = docs.orderBy("doc_id").limit(150)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(some, model).collect()}
    for r in some.collect():
        x = brute_features(r.text or "", model.lexicon)
        f = model.trees.start
        for split, value in model.trees.trees:
            node = 0
            for _ in range(toxicity.DEPTH):
                column, cut = split[node]
                node = 2 * node + 1 + (sum(e < x[column] - 1e-12 for e in model.trees.edges[column]) > cut)
            f += value[node - 7]
        assert abs(got[r.doc_id] - float(np.clip(np.interp(f, *model.knots), 0, 1))) < 1e-6


def test_language_scores_equal_a_plain_convolution(spark):
    docs = docs_of(spark, SF)
    net = langid.fit(docs)
    some = docs.orderBy("doc_id").filter("length(text) < 1200").limit(6)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(some, net).collect()}
    width = np.repeat(langid.WIDTHS, langid.FILTERS)
    for r in some.collect():
        raw, total = (r.text or "").encode(), np.zeros(len(net.classes))
        for at in range(0, max(1, len(raw)), 256):
            part = [*raw[at : at + 256], *[256] * (256 - len(raw[at : at + 256]) + 4)]
            hidden = []
            for f, n in enumerate(width):
                kernel = net.kernel[: n * langid.EMBED, f].reshape(n, langid.EMBED)
                hidden.append(max(0.0, max(sum(float(net.embed[part[p + k]] @ kernel[k]) for k in range(n)) for p in range(256)) + net.bias[f]))
            z = np.array(hidden) @ net.out + net.out_bias
            total += (z - z.max() - np.log(np.exp(z - z.max()).sum())) * max(1, len(raw[at : at + 256]))
        p = np.exp(total / max(1, len(raw)) - (total / max(1, len(raw))).max())
        p /= p.sum()
        assert got[r.doc_id][0] == net.classes[int(p.argmax())] and abs(got[r.doc_id][1] - p.max()) < 1e-3


def test_dual_descent_reaches_the_optimum(spark):
    docs = docs_of(spark, SF)
    texts, y = labelled.fitting_texts(docs, labelled.sample(spark.read.parquet(f"{SF}/labels.parquet"), "quality", 300, 3, 1))
    model, y = quality_model.NbSvm(), np.array(y)
    model.fit(texts, y)
    order = np.random.default_rng(labelled.SEED).permutation(len(y))
    train = order[len(order) // 5 :]
    sign = 2.0 * y[train] - 1
    w, bias = model.primal
    most = quality_model.PENALTY * len(train) / (2 * np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum()))
    sums, loss = np.zeros_like(w), 0.0
    for k, s, a, c in zip(train, sign, model.dual, most, strict=True):
        _, f = quality_model.ngrams(pa.array([texts[k]]))
        x = model.ratio[f] / max(np.linalg.norm(model.ratio[f]), 1e-9)
        sums[f] += a * s * x
        loss += c * max(0.0, 1 - s * (w[f] @ x + bias))
    assert (model.dual >= 0).all() and (model.dual <= most + 1e-9).all() and np.allclose(sums, w, atol=1e-4)
    norm = 0.5 * (w @ w + bias * bias)
    primal, dual = norm + loss, model.dual.sum() - norm
    assert 0 <= primal - dual < 0.05 * primal


def test_quality_scores_equal_a_text_by_text_version(spark):
    docs = docs_of(spark, SF)
    model = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    some = docs.orderBy("doc_id").limit(60)
    got = {r.doc_id: r.score for r in quality_model.score_quality(some, model).collect()}
    for r in some.collect():
        _, f = quality_model.ngrams(pa.array([r.text], pa.string()))
        top, norm = sum(float(model.ratio[k]) * float(model.weight[k]) for k in f), math.sqrt(sum(float(model.ratio[k]) ** 2 for k in f))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-(model.slope * (model.bias + top / max(norm, 1e-9)) + model.shift)))) < 1e-5


def test_samples_are_bounded_and_hold_one_text_for_each_id(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(r[0], 1, 1) for r in ODD], "doc_id long, quality int, toxic int")
    picked = labelled.sample(labels, "toxic", 100, 3, 5)
    texts, y = labelled.fitting_texts(docs, picked)
    assert len(texts) == len({r[0] for r in ODD if r[0] is not None}) and set(y) == {1}
    longest = max(len(t.encode()) for t in texts)
    small, _ = labelled.fitting_texts(docs, picked, longest=1000)
    assert longest > 1000 and max(len(t.encode()) for t in small) <= 1000
    few, _ = labelled.fitting_texts(docs, picked, most=600, longest=1000)
    assert few == small[: len(few)] and sum(len(t.encode()) for t in few) <= 600 < sum(len(t.encode()) for t in small)
