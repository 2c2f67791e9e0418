"""Operator 9: quality classifier by naive Bayes support vectors.

A text is the set of its hashed n-grams: words, word pairs, word endings, and runs of word shapes (case, last character,
whether a word repeats the one before), which carry over to words never seen. Indicators are scaled by the classes'
log-count ratio, normalised, and a linear hinge-loss model is fitted by dual coordinate descent; its weights are
interpolated with their mean magnitude over all features of the sample. A logistic curve, fitted on rows apart, turns the margin into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.llm.common import Words, mix, raw_text, read, slices, small_batches
from threatframe.llm.labelled import SEED, fitting_texts, remainder, sample

SAMPLE = 6000  #: labelled texts that the model is fitted on, at most
BITS = 18  #: of the hashed feature space
CHUNK = 200  #: texts whose n-grams are taken at once in fitting
SMOOTH = 1.0
PENALTY = 1.0  #: C of the hinge loss
EPOCHS = 12
MIX = 0.25  #: interpolation between the mean magnitude and the fitted weights


def ngrams(arr: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each distinct n-gram of each text, sorted by text."""
    w = Words(*raw_text(arr))
    n = len(w)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = w.raw
    after = np.append(raw[1:], 0)
    upper = ((raw >= 65) & (raw <= 90)) | ((raw == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    lower = ((raw >= 97) & (raw <= 122)) | ((raw >= 0xC3) & ~upper)
    ups, lows = (np.concatenate(([0], np.cumsum(x))) for x in (upper, lower))
    ups, lows = ups[w.end] - ups[w.start], lows[w.end] - lows[w.start]
    h = w.hashes()
    first = np.zeros(n, bool)  # words that begin a text
    first[w.first[:-1][w.count > 0]] = True
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & ~first[1:]
    last = raw[w.end - 1].astype(np.uint64)
    last[(last >= 128) | ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90))] = 1
    case = np.select([(ups == 0) & (lows == 0), lows == 0, ups == 0, upper[w.start] & (ups == 1)], [0, 1, 2, 3], 4).astype(np.uint64)
    shape = mix(case * np.uint64(1009) + last * np.uint64(8) + same.astype(np.uint64) + np.uint64(77))
    tail = np.zeros(n, np.uint64)
    for k in (1, 2, 3):
        at = w.end - k
        tail = tail * np.uint64(257) + np.where(at >= w.start, raw[np.maximum(at, 0)], 0).astype(np.uint64)
    kinds = [h, mix(tail + np.uint64(1)), shape]
    texts = [w.doc] * 3
    pair = ~first[1:]
    triple = pair[1:] & pair[:-1]
    kinds += [
        mix(h[:-1] * np.uint64(3) + h[1:])[pair],
        mix(shape[:-1] * np.uint64(5) + shape[1:])[pair],
        mix(shape[:-2] * np.uint64(49) + shape[1:-1] * np.uint64(7) + shape[2:])[triple],
    ]
    texts += [w.doc[1:][pair], w.doc[1:][pair], w.doc[2:][triple]]
    feature = np.concatenate([mix(k + np.uint64(i + 1)) >> np.uint64(64 - bits) for i, k in enumerate(kinds)]).astype(np.int64)
    key = np.unique((np.concatenate(texts) << bits) | feature)
    return key >> bits, key & ((1 << bits) - 1)


class NbSvm:
    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.ratio = np.zeros(1 << bits, np.float32)
        self.weight = np.zeros(1 << bits, np.float32)
        self.bias, self.slope, self.shift = 0.0, 1.0, 0.0

    def fit(self, texts: list[str], y: np.ndarray, seed: int = SEED) -> NbSvm:
        """y: 0 or 1. Without both classes the score is the share of label 1."""
        y = np.asarray(y)
        if len(set(y.tolist())) < 2:
            self.shift = 4.0 * (2 * y.mean() - 1) if len(y) else 0.0
            return self
        sets: list[np.ndarray] = []
        for k in range(0, len(texts), CHUNK):
            part = texts[k : k + CHUNK]
            doc, feature = ngrams(pa.array(part, pa.string()), self.bits)
            sets += np.split(feature.astype(np.int32), np.searchsorted(doc, np.arange(1, len(part))))
        order = np.random.default_rng(seed).permutation(len(texts))
        apart, train = order[: len(order) // 5], order[len(order) // 5 :]
        if len(set(y[train].tolist())) < 2:
            train = order
        counts = np.full((2, 1 << self.bits), SMOOTH)
        for k in train:
            counts[y[k], sets[k]] += 1  # a text's features are distinct
        q, p = counts
        self.ratio = np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)
        seen = (p > SMOOTH) | (q > SMOOTH)
        self.ratio[~seen] = 0  # a feature without counts says nothing
        rows = []
        for f in sets:
            x = self.ratio[f]
            rows.append((f, x / max(np.linalg.norm(x), 1e-9)))
        self._descend([rows[k] for k in train], 2.0 * y[train] - 1, seed, int(seen.sum()))
        self._calibrate(np.array([self.bias + self.weight[f] @ x for f, x in (rows[k] for k in apart)]), y[apart])
        return self

    def _descend(self, rows: list, sign: np.ndarray, seed: int, features: int) -> None:
        """Dual coordinate descent for the hinge loss (Hsieh et al. 2008); classes weigh alike. The result is
        interpolated with the mean magnitude of the weights over `features` features (Wang and Manning 2012)."""
        r = np.random.default_rng(seed)
        w, bias, alpha = np.zeros(1 << self.bits), 0.0, np.zeros(len(rows))
        most = PENALTY * len(rows) / (2 * np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum()))
        for _ in range(EPOCHS):
            for k in r.permutation(len(rows)):
                f, x = rows[k]
                slack = sign[k] * (w[f] @ x + bias) - 1
                new = min(max(alpha[k] - slack / 2.0, 0.0), most[k])  # |x|^2 + the constant feature's 1
                if new != alpha[k]:
                    step = (new - alpha[k]) * sign[k]
                    w[f] += step * x
                    bias += step
                    alpha[k] = new
        self.dual, self.primal = alpha, (w.copy(), bias)
        self.weight = (MIX * w + (1 - MIX) * np.abs(w).sum() / max(1, features)).astype(np.float32)
        self.bias = MIX * bias

    def _calibrate(self, margin: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of the label on the margin, by Newton steps with a small ridge."""
        if len(set(y.tolist())) < 2:
            self.slope = 4.0
            return
        scale = max(margin.std(), 1e-9)
        x = np.stack([margin / scale, np.ones_like(margin)], axis=1)
        t = np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
            ridge = 0.5 * np.eye(2)
            t -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ t)
        self.slope, self.shift = t[0] / scale, t[1]

    def score(self, arr: pa.Array) -> np.ndarray:
        doc, feature = ngrams(arr, self.bits)
        r = self.ratio[feature]
        n = len(arr)
        total = np.bincount(doc, weights=r * self.weight[feature], minlength=n)
        norm = np.sqrt(np.bincount(doc, weights=r * r, minlength=n))
        margin = self.bias + total / np.maximum(norm, 1e-9)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> NbSvm:
    """Fit on at most `rows` labelled texts of at most SAMPLE_BYTES together, outside the held-out part (crc32 modulo 3 is 1).

    A doc_id that labels repeat has its largest label, one that docs repeat its least text; null doc_ids and null labels
    are not learned from. Without labels the model gives a constant score.
    """
    texts, y = fitting_texts(docs, sample(labels, "quality", rows, 3, 1))
    return NbSvm().fit(texts, np.array(y, np.int64))


def score_quality(docs: DataFrame, model: NbSvm) -> DataFrame:
    """doc_id, score for every text, scored whole; null and empty texts get the score of the bias alone, repeated rows
    score alike, other columns are ignored, no rows give no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op9_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scores = score_quality(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scores.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
