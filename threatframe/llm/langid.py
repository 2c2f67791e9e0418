"""Operator 8: language identification with a byte convolutional network.

Byte embeddings, convolutions of several widths, max pooling over a fixed-length window and softmax, trained in numpy
(Adam) on labelled windows. A text is cut into windows that cover all of it; their log-probabilities are averaged by
length. The label sample is bounded (SAMPLE rows); the parameters are a few kilobytes and are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.llm.common import raw_text, read, slices, small_batches
from threatframe.llm.labelled import SEED, remainder

SAMPLE = 4000  #: labelled texts that the network is fitted on, at most
WINDOW = 256  #: bytes
EMBED = 8
WIDTHS = (2, 3, 4, 5)
FILTERS = 12  #: of each width
SPAN = max(WIDTHS)
EPOCHS = 6
CHUNK = 64  #: windows scored at once
_LETTER = re.compile(rb"[A-Za-z]")


class ByteConvNet:
    """softmax(W . maxpool(relu(conv(embed(bytes)))) + b) with filters of several widths.

    All widths stand in one kernel of the largest width, with zeros beyond a filter's own width, so a window is one
    matrix product. Code 256 stands for places after a text's end; its embedding is zero.
    """

    def __init__(self, classes: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.embed = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.embed[256] = 0
        width = np.repeat(WIDTHS, FILTERS)
        self.mask = (np.arange(SPAN * EMBED)[:, None] // EMBED < width).astype(np.float32)
        self.kernel = (r.normal(0, 1, self.mask.shape) / np.sqrt(width * EMBED)).astype(np.float32) * self.mask
        self.bias = np.zeros(len(width), np.float32)
        self.out = (r.normal(0, 1, (len(width), len(classes))) / np.sqrt(len(width))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def _responses(self, codes: np.ndarray) -> np.ndarray:
        """(filter, window, place): every filter at every place of every window."""
        n, length = codes.shape
        x = self.embed[np.concatenate((codes, np.full((n, SPAN - 1), 256, codes.dtype)), axis=1)]
        s = x.strides
        runs = np.lib.stride_tricks.as_strided(x, (n, length, SPAN * EMBED), s)
        return (self.kernel.T @ runs.reshape(-1, SPAN * EMBED).T).reshape(-1, n, length)

    def log_proba(self, codes: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self._responses(codes).max(axis=2).T + self.bias, 0)
        z = hidden @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, codes: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 4e-3, seed: int = SEED) -> ByteConvNet:
        r = np.random.default_rng(seed)
        params = [self.embed, self.kernel, self.bias, self.out, self.out_bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for k in range(0, len(y), batch):
                t += 1
                grads = self._gradients(codes[order[k : k + batch]], y[order[k : k + batch]])
                for p, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
                self.embed[256] = 0
        return self

    def _gradients(self, codes: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        y = self._responses(codes)
        best = y.argmax(axis=2).T  # window, filter
        hidden = np.maximum(np.take_along_axis(y, best.T[:, :, None], 2)[:, :, 0].T + self.bias, 0)
        z = hidden @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(label)), label] -= 1
        p /= len(label)
        g = (p @ self.out.T) * (hidden > 0)
        padded = np.concatenate((codes, np.full((len(codes), SPAN - 1), 256, codes.dtype)), axis=1)
        seen = padded[np.arange(len(codes))[:, None, None], best[:, :, None] + np.arange(SPAN)]
        x = self.embed[seen].reshape(*best.shape, SPAN * EMBED)
        kernel = np.einsum("nf,nfd->df", g, x) * self.mask
        embed = np.zeros_like(self.embed)
        np.add.at(embed, seen.reshape(-1), (g[:, :, None] * self.kernel.T).reshape(-1, EMBED))
        return [embed, kernel, g.sum(axis=0), hidden.T @ p, p.sum(axis=0)]


def windows(raw: np.ndarray, offs: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, text, bytes): fixed-length windows that cover every text; places after its end hold 256."""
    length = np.diff(offs)
    n = np.maximum(1, -(-length // size))
    text = np.repeat(np.arange(len(length)), n)
    begin = offs[:-1][text] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size
    have = np.minimum(size, offs[1:][text] - begin)
    padded = np.concatenate((raw, np.zeros(size, np.uint8)))
    codes = padded[begin[:, None] + np.arange(size)].astype(np.int16)
    codes[np.arange(size)[None] >= have[:, None]] = 256
    return codes, text, have


def _scored(net: ByteConvNet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            raw, offs = raw_text(batch.column(1))
            codes, text, have = windows(raw, offs)
            logs = np.concatenate([net.log_proba(codes[k : k + CHUNK]) for k in range(0, len(codes), CHUNK)])
            total = np.zeros((len(offs) - 1, len(net.classes)))
            np.add.at(total, text, logs * np.maximum(have, 1)[:, None])
            total /= np.maximum(np.diff(offs), 1)[:, None]
            p = np.exp(total - total.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            data = raw.tobytes()
            lang, score = [], p[np.arange(len(best)), best]
            for k, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
                ok = _LETTER.search(data, a, b) or any(c.isalpha() for c in data[a:b].decode("utf-8", "replace"))
                lang.append(net.classes[best[k]] if ok else "und")
                score[k] = score[k] if ok else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"])

    return run


def fit(docs: DataFrame, rows: int = SAMPLE, modulus: int = 4, held: int = 2) -> ByteConvNet:
    """Fit on at most `rows` labelled texts outside the held-out part, in seeded hash order.

    One or two windows are drawn at seeded places of each sampled text, on Spark, so a few hundred bytes of a text reach
    the driver, however long it is. Null texts and labels are not learned from. With fewer than one label nothing can be
    learned: the network then has the single class `und`.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(modulus) != held))
    total = known.count()
    h = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20))
    if total > rows:  # a hash threshold first, so that only about this many texts are moved
        known = known.filter(h < int(1.2 * rows / total * (1 << 20)) + 1)
    raw, size = F.encode("text", "UTF-8"), F.octet_length("text")
    draw = lambda k, most: F.pmod(F.xxhash64(F.lit(SEED + k), "doc_id"), F.greatest(F.lit(1), most))
    width = lambda k: F.when(draw(10 + k, F.lit(10)) < 7, WINDOW).otherwise(16 + draw(20 + k, F.lit(WINDOW - 16))).cast("int")
    window = lambda k: F.substring(raw, (1 + draw(k, size - WINDOW + 1)).cast("int"), width(k))
    parts = F.array(window(1), F.when(size > 4 * WINDOW, window(2)))
    known = known.filter(size > 0).select(parts.alias("parts"), F.col("lang").cast("string").alias("lang"), h.alias("at"), "doc_id")
    picked = known.orderBy("at", "doc_id", "parts").limit(rows).select("parts", "lang").collect()
    classes = sorted({r.lang for r in picked}) or ["und"]
    net = ByteConvNet(classes)
    if len(classes) == 1:
        return net
    parts = [bytes(p) for r in picked for p in r.parts if p is not None]
    labels = [classes.index(r.lang) for r in picked for p in r.parts if p is not None]
    codes = np.full((len(parts), WINDOW), 256, np.int16)
    for k, p in enumerate(parts):
        codes[k, : len(p)] = np.frombuffer(p, np.uint8)
    return net.fit(codes, np.array(labels))


def identify(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """doc_id, lang_pred, score for every text, read whole; null texts and texts without a letter are `und` with score 0,
    repeated rows get the same language, other columns are ignored, no rows give no rows."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(net), "doc_id long, lang_pred string, score double")


def op8_byte_convnet_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
