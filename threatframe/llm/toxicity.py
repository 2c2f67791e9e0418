"""Operator 2: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text: densities of learned lexicons (words, and word stems of four and five letters, found after
undoing obfuscation), how often such hits stand near a second-person word, capitals, punctuation and obfuscation rates.
The lexicons, the trees and the calibration are learned on three disjoint parts of a bounded label sample, so that none
trusts what another has memorised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.llm.common import per_text, read, slices, small_batches, words_of
from threatframe.llm.labelled import SEED, fitting_texts, remainder, sample

SAMPLE = 9000  #: labelled texts that the model is fitted on, at most
PARTS = (0.5, 0.35)  #: of the sample for the lexicons and for the trees; the rest calibrates
LEAST_TEXTS = 4  #: toxic texts that must hold a lexicon entry
RATIO = 12.0  #: how much more frequent an entry is in toxic texts
NEAR = 5  #: words around a hit in which a second-person word counts
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 48
THRESHOLD = 0.7

#: Second-person words of the corpus languages, and characters that stand for letters.
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

LEXICONS = ("words", "stem5", "stem4")


class Tokens:
    """Words of many texts with their cleaned forms; distinct words are cleaned once."""

    def __init__(self, arr: pa.Array):
        w = self.w = words_of(arr)
        _, at, self.which = np.unique(w.hashes(), return_index=True, return_inverse=True)
        data = w.raw.tobytes()
        plain = pa.array([data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
        low = pc.utf8_lower(plain)
        self.second = np.asarray(pc.is_in(pc.utf8_trim(low, ".,;:!?\"'()"), value_set=pa.array(SECOND)))
        self.odd = np.asarray(pc.match_substring_regex(low, r"\pL[0-9@$*!._-]+\pL"))
        for mark, letter in LEET.items():
            low = pc.replace_substring(low, mark, letter)
        clean = pc.replace_substring_regex(low, r"[^\pL]", "")
        size = np.asarray(pc.utf8_length(clean))
        self.forms = {"words": clean}
        for k in (5, 4):
            self.forms[f"stem{k}"] = pc.if_else(pa.array(size >= k), pc.utf8_slice_codeunits(clean, 0, k), pa.scalar(""))


class Lexicon:
    def __init__(self):
        self.entries = {k: pa.array([], pa.string()) for k in LEXICONS}

    def fit(self, texts: list[str], y: np.ndarray) -> Lexicon:
        """Entries that are at least RATIO times as frequent, by texts, under label 1."""
        positive, negative = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
        for kind in LEXICONS:
            found: dict[str, list[int]] = {}
            for k in range(0, len(texts), 500):
                t = Tokens(pa.array(texts[k : k + 500], pa.string()))
                coded = t.forms[kind].dictionary_encode()
                if not len(coded):
                    continue
                code = np.asarray(coded.indices)[t.which]
                pairs = np.unique(t.w.doc * len(coded.dictionary) + code)
                toxic = y[k + pairs // len(coded.dictionary)] == 1
                code = pairs % len(coded.dictionary)
                counts = [np.bincount(code[m], minlength=len(coded.dictionary)) for m in (toxic, ~toxic)]
                for word, a, b in zip(coded.dictionary.to_pylist(), *counts, strict=True):
                    c = found.setdefault(word, [0, 0])
                    c[0] += int(a)
                    c[1] += int(b)
            chosen = [s for s, (a, b) in found.items() if s and a >= LEAST_TEXTS and a / positive >= RATIO * (b + 0.5) / negative]
            self.entries[kind] = pa.array(sorted(chosen), pa.string())
        return self


def features(arr: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of dense features per text."""
    t = Tokens(arr)
    w, n = t.w, np.maximum(t.w.count, 1)
    hits = {k: np.asarray(pc.is_in(t.forms[k], value_set=lexicon.entries[k]))[t.which] for k in LEXICONS}
    second, odd = t.second[t.which], t.odd[t.which]
    anywhere = hits["words"] | hits["stem5"] | hits["stem4"]
    ahead = np.concatenate(([0], np.cumsum(second)))
    place = np.arange(len(w))
    lo, hi = np.maximum(place - NEAR, w.first[w.doc]), np.minimum(place + NEAR + 1, w.first[w.doc + 1])
    near = anywhere & (ahead[hi] - ahead[lo] - second > 0)
    raw = w.raw
    after = np.append(raw[1:], 0)[: len(raw)]
    upper = ((raw >= 65) & (raw <= 90)) | ((raw == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 0xC3)
    ups, letters = (np.concatenate(([0], np.cumsum(x))) for x in (upper, letter))
    ups, letters = ups[w.end] - ups[w.start], letters[w.end] - letters[w.start]
    shout = (ups > 1) & (ups == letters)
    punct = ((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))
    size = np.maximum(np.diff(w.offs), 1)
    columns = []
    for x in (*hits.values(), anywhere, near, anywhere & odd, second, odd, shout):
        count = per_text(x, w.first)
        columns += [count / n, np.log1p(count)]
    for x in (upper, punct, raw == 33, raw == 63, (raw >= 48) & (raw <= 57), (raw == 42) | (raw == 64) | (raw == 36)):
        columns.append(per_text(x, w.offs) / size)
    return np.stack([*columns, np.log1p(w.count), per_text(w.end - w.start, w.first) / n], axis=1)


class BoostedTrees:
    """Gradient boosting of the logistic loss with histogram trees of fixed depth."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self._bins(x)
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.trees = []
        f, d = np.full(len(y), self.start), x.shape[1]
        flat = b + np.arange(d) * BINS
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            split = np.zeros((2**DEPTH - 1, 2), np.int64)
            for level in range(DEPTH):
                base, width = 2**level - 1, 2**level
                at = ((node - base)[:, None] * d * BINS + flat).ravel()
                gs, hs = (np.bincount(at, np.repeat(v, d), width * d * BINS).reshape(width, d, BINS).cumsum(axis=2) for v in (g, h))
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = -1
                best = gain.reshape(width, -1).argmax(axis=1)
                top = gain.reshape(width, -1).max(axis=1)
                split[base : base + width] = np.stack([best // BINS, np.where(top > 1e-6, best % BINS, BINS)], axis=1)
                chosen = split[node]
                node = 2 * node + 1 + (b[np.arange(len(b)), chosen[:, 0]] > chosen[:, 1])
            leaf = node - (2**DEPTH - 1)
            value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            self.trees.append((split, value))
            f += value[leaf]
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        f = np.full(len(x), self.start)
        for split, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[np.arange(len(b)), split[node, 0]] > split[node, 1])
            f += value[node - (2**DEPTH - 1)]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots of the best nondecreasing fit. One imagined row of each label at the ends
    keeps the fitted values inside (0, 1)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for a, b in [(x.min() - 1, 0.0), *zip(x[order], y[order], strict=True), (x.max() + 1, 1.0)]:
        blocks.append([float(b), 1.0, float(a), float(a)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    xs, ys = [], []
    for s, n, first, last in blocks:
        value = (s + 0.01) / (n + 0.02)
        xs += [first, last] if last > first else [first]
        ys += [value, value] if last > first else [value]
    return np.array(xs), np.array(ys)


class ToxicityModel:
    def __init__(self):
        self.lexicon, self.trees, self.knots, self.constant = Lexicon(), None, None, 0.0

    def fit(self, texts: list[str], y: np.ndarray, seed: int = SEED) -> ToxicityModel:
        """y: 0 or 1. Without both classes in every part the score is the share of label 1."""
        y = np.asarray(y)
        self.constant = float(y.mean()) if len(y) else 0.0
        order = np.random.default_rng(seed).permutation(len(y))
        cuts = [int(PARTS[0] * len(y)), int(sum(PARTS) * len(y))]
        parts = np.split(order, cuts)
        if any(len(set(y[p].tolist())) < 2 for p in parts):
            return self
        pick = lambda p: [texts[k] for k in p]
        self.lexicon.fit(pick(parts[0]), y[parts[0]])
        of = lambda p: np.concatenate([features(pa.array(pick(p[k : k + 500]), pa.string()), self.lexicon) for k in range(0, len(p), 500)])
        self.trees = BoostedTrees().fit(of(parts[1]), y[parts[1]])
        self.knots = isotonic(self.trees.margin(of(parts[2])), y[parts[2]])
        return self

    def score(self, arr: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(arr), self.constant)
        return np.clip(np.interp(self.trees.margin(features(arr, self.lexicon)), *self.knots), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> ToxicityModel:
    """Fit on at most `rows` labelled texts of at most SAMPLE_BYTES together, outside the held-out part (crc32 modulo 3 is 1).

    A doc_id that labels repeat has its largest label, one that docs repeat its least text; null doc_ids and null labels
    are not learned from. Without labels the model gives a constant score.
    """
    texts, y = fitting_texts(docs, sample(labels, "toxic", rows, 3, 1))
    return ToxicityModel().fit(texts, np.array(y, np.int64))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score for every text, scored whole; null texts count as empty, repeated rows score alike, other columns are
    ignored, no rows give no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op2_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scores = score_toxicity(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scores.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
