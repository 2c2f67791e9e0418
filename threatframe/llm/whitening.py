"""Operator 13: embedding whitening by spectrum slicing.

Entries become whole numbers (64 c, rounded down, plus 1,000,000), and the fit is over the distinct vectors. Two passes over
them give exact sums and the covariance about the mean; only these d and d * d numbers reach the driver. There the leading
eigenvalues are isolated by inertia counts: the LDL' form of V - s I has as many positive pivots as V has eigenvalues above
s. Within an interval that holds one eigenvalue, Rayleigh quotient iteration converges cubically, and two more counts
certify its number. A third pass measures the covariance of the whitened fit list.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.llm.common import read, small_batches, staged

COMPONENTS = 16
SCALE, SHIFT = 64.0, 1_000_000
LARGEST = 1 << 55  #: entries of a larger magnitude count as this, so that sums stay whole numbers
BLOCK = 4096  #: vectors that a product takes at once
RANK_TOLERANCE = 1e-10  #: eigenvalues below this share of the first are noise of the covariance: no component
EPS = np.finfo(float).eps


class Model(NamedTuple):
    """n and sums (whole numbers less SHIFT) of the fit list; eigenvalues, unit eigenvectors in columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


# Inertia, slicing and Rayleigh quotients: small dense matrices.


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed shift: positive pivots of LDL' with 1x1 and 2x2 pivots (Bunch and
    Kaufman 1977); a 2x2 pivot of that form has one eigenvalue of each sign."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, above, alpha = len(a), 0, 0, (1 + 17**0.5) / 8
    while k < n:
        below = np.abs(a[k + 1 :, k])
        most = below.max() if len(below) else 0.0
        if most == 0:
            above += a[k, k] > 0
            k += 1
            continue
        swap, two = k, False
        if abs(a[k, k]) < alpha * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < alpha * most * most:
                two = abs(a[r, r]) < alpha * row.max()
                swap = r
        to = k + two
        if swap != to and swap != k:
            a[[to, swap]] = a[[swap, to]]
            a[:, [to, swap]] = a[:, [swap, to]]
        end = k + 1 + two
        left = a[end:, k:end]
        above += 1 if two else int(a[k, k] > 0)
        a[end:, end:] -= left @ np.linalg.solve(a[k:end, k:end], left.T) if two else np.outer(left[:, 0] / a[k, k], left[:, 0])
        k = end
    return int(above)


def _solve(matrix: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    for nudge in (0.0, EPS, 8 * EPS, 64 * EPS):
        try:
            w = np.linalg.solve(matrix - (shift + nudge * scale) * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(w).all():
            return w
    raise ArithmeticError("no shift near an eigenvalue gave a solution")


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` leading eigenvalues above the rank tolerance, falling, with unit eigenvectors in columns.

    Eigenvalues that 1e-13 of the norm does not tell apart share an orthonormal basis of their space.
    """
    n = len(matrix)
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    low, high = float((np.diag(matrix) - radius).min()), float((np.diag(matrix) + radius).max())
    scale = max(abs(low), abs(high))
    if scale == 0:
        return np.zeros(0), np.zeros((n, 0))
    counts = {low - 4 * EPS * scale * n: n, high + 4 * EPS * scale * n: 0}
    rng = np.random.default_rng(13)

    def around(k: int) -> tuple[float, float]:
        """The closest shifts so far with at least k, and with fewer than k, eigenvalues above them."""
        return max(s for s, c in counts.items() if c >= k), min(s for s, c in counts.items() if c < k)

    def cut(k: int) -> tuple[float, float]:
        a, b = around(k)
        counts[(a + b) / 2] = count_above(matrix, (a + b) / 2)
        return around(k)

    values: list[float] = []
    vectors = np.zeros((n, 0))

    def own(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - vectors @ (vectors.T @ v)
        return v

    while len(values) < min(most, n):
        k = len(values) + 1
        a, b = around(k)
        while counts[a] - counts[b] > 1 and b - a > 1e-13 * scale:
            a, b = cut(k)
        together = counts[a] - counts[b]
        if values and b < RANK_TOLERANCE * values[0]:
            break
        v = np.linalg.qr(rng.standard_normal((n, together)))[0]
        shift, best = (a + b) / 2, None
        for _ in range(200):
            v = np.linalg.qr(own(_solve(matrix, shift, v, scale)))[0]
            quotient = float(np.mean(np.sum(v * (matrix @ v), axis=0)))
            residual = float(np.abs(matrix @ v - v * quotient).max())
            inside = a <= quotient <= b
            if inside and residual <= 4 * EPS * scale * n**0.5:
                best = quotient
                break
            if inside and together == 1:
                shift = quotient
            elif b - a > 4 * EPS * scale:
                a, b = cut(k)  # the iteration strayed: narrow the interval that must hold it
                shift = (a + b) / 2
            else:
                best = quotient
                break
        if best is None:
            raise ArithmeticError(f"eigenvalue {k} did not converge")
        margin = max(8 * residual, 16 * EPS * scale * n**0.5, (b - a) if together > 1 else 0)
        if not count_above(matrix, best + margin) < k <= k + together - 1 <= count_above(matrix, best - margin):
            raise ArithmeticError(f"counts do not certify eigenvalue {k}")
        if best < RANK_TOLERANCE * (values[0] if values else scale):
            break
        values += [best] * together
        vectors = np.concatenate([vectors, v], axis=1)
    vectors = vectors[:, :most]
    return np.array(values[:most]), vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


# Passes over the vectors.


def _usable(rows: DataFrame, column: str) -> DataFrame:
    e = F.col(column)
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return rows.filter(e.isNotNull() & (F.size(e) > 0)).filter(~bad)


def _whole(lists: pa.Array, size: int) -> np.ndarray:
    """(rows, size) whole numbers, less SHIFT, of lists of one length."""
    c = np.asarray(lists.flatten().cast(pa.float64())).reshape(-1, size)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -float(LARGEST), float(LARGEST)).astype(np.int64)


def _pack(row: np.ndarray) -> bytes:
    """One vector in the narrowest integers that hold it: equal vectors and no others give equal bytes."""
    low, high = int(row.min()), int(row.max())
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + row.astype(f"<i{width}").tobytes()


def _unpack(packed: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(packed), size), np.int64)
    widths = np.array([p[0] for p in packed])
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join(packed[i][1:] for i in at), f"<i{w}").reshape(-1, size)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        sizes = np.asarray(lists.value_lengths())
        for size in np.unique(sizes):
            rows = _whole(lists.filter(pa.array(sizes == size)), int(size))
            yield pa.RecordBatch.from_arrays([pa.array([_pack(r) for r in rows], pa.binary()), pa.array(np.full(len(rows), size), pa.int32())], ["packed", "size"])


def _sums(fit: DataFrame, size: int) -> list[int]:
    """Per-dimension sums of the packed vectors, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            rows = _unpack(batch.column(0).to_pylist(), size)
            high, low = (rows >> 28).sum(axis=0), (rows & ((1 << 28) - 1)).sum(axis=0)  # no overflow below 2**34 rows a batch
            total = [t + (int(h) << 28) + int(x) for t, h, x in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([str(t) for t in total])], ["at", "total"])

    got = fit.select("packed").mapInArrow(run, "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return [int(r.total) for r in got.orderBy("at").collect()]


def _products(fit: DataFrame, centre: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
    """Sums of z z' over the packed vectors, z their offset from the centre, projected where `onto` is given."""
    size = len(centre)
    out = size if onto is None else onto.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((out, out))
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                z = _unpack(batch.column(0).slice(k, BLOCK).to_pylist(), size) - centre
                z = z if onto is None else z @ onto
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(out), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = fit.select("packed").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    got = rows.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((out, out))
    total[np.asarray(got["i"]), np.asarray(got["j"])] = np.asarray(got["v"])
    return (total + total.T) / 2


def fit_whitening(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The whitening of the distinct whole-number vectors of a table; None where no row has a usable vector.

    Vectors of the commonest length count (of the longest such length, if tied); see `whiten`.
    """
    fit = _usable(vectors.select(F.col(column).alias("embedding")), "embedding").mapInArrow(_packed, "packed binary, size int")
    fit = staged(fit.distinct(), "fit")
    common = fit.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return None
    n = int(common["count"])
    fit = fit.filter(F.col("size") == common["size"])
    sums = _sums(fit, int(common["size"]))
    model = Model(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0, 0.0)
    covariance = _products(fit, model.centre) / n
    values, found = leading(covariance, components)
    model = model._replace(values=values, vectors=found, trace=float(np.trace(covariance)))
    if not len(values):
        return model
    white = _products(fit, model.centre, found / np.sqrt(values)) / n
    return model._replace(identity_error=float(np.abs(white - np.eye(len(values))).max()))


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Dropped: rows whose vector is null, empty, or holds a null, infinite or NaN entry, and rows whose length is not the
    commonest one. Repeated rows are all returned and fitted once; a null key stays null; other columns are ignored,
    whatever they are called. Components of no variance (fewer distinct vectors than components, say) are left out, and
    an empty table, or one whose vectors are all equal, gives no rows. A deviation beyond 64 bits is null.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{column}`").alias("embedding"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(rows, "embedding", components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    size, k = len(model.sums), len(model.values)
    centre, onto = model.centre, model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch.column(1), size)
            out = (x - centre) @ onto
            if (int(np.abs(x).max()) * model.n + max(map(abs, model.sums))) ** 2 * size < 1 << 62:
                deviation = ((x * model.n - np.array(model.sums)) ** 2).sum(axis=1).tolist()
            else:
                exact = (sum((model.n * int(c) - s) ** 2 for c, s in zip(r, model.sums, strict=True)) for r in x)
                deviation = [d if d < 1 << 63 else None for d in exact]
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(each), model.n), pa.int64()),
                    pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(out.ravel(), pa.float64()),
                    pa.array(np.tile(model.values / model.trace, len(x)), pa.float64()),
                    pa.array(np.full(len(each), model.identity_error), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return _usable(rows, "embedding").filter(F.size("embedding") == size).mapInArrow(run, schema)


def op13_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
