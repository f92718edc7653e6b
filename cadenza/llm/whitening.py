"""Whitening of embeddings: blockwise TSQR in tasks, one-sided Jacobi rotations of the small triangle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are triangularised at once, and triangles that one task of the next level takes.
ROWS, FAN_IN = 4096, 32
#: Entries from this size on are no integers that a double holds exactly.
EXACT = 1 << 53


@dataclass(frozen=True)
class Model:
    """``n`` fitted vectors with sums ``S`` per dimension; unit components as columns, and their standard deviations."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    deviations: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``: the whole part of the mean is taken off as an integer first."""
        return centred(x, self.n, self.sums)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in sums])


def integers(column: pa.Array, width: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * c) + shift`` of the vectors of ``width`` finite entries, and which rows these are."""
    sizes = np.where(np.asarray(column.is_valid()), np.asarray(column.value_lengths().fill_null(0)), -1)
    ok = (sizes == width) & (width > 0)
    flat = column.filter(pa.array(ok)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, max(width, 1))
    scaled = np.floor(scale * flat)
    fine = (np.abs(scaled) < EXACT).all(axis=1)  # false for a non-finite entry
    ok[np.flatnonzero(ok)[~fine]] = False
    return scaled[fine].astype(np.int64) + shift, ok


def common_width(vectors: DataFrame, column: str) -> int:
    """The width that most vectors have, of several the largest; 0 if there is none."""
    row = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return row["w"] if row else 0


def triangles(batches: Iterator[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """The triangle of all rows of a task, from blocks of them under the triangle so far."""
    r = np.zeros((0, width))
    for x in batches:
        for at in range(0, len(x), ROWS):
            r = np.linalg.qr(np.vstack([r, x[at : at + ROWS]]), mode="r")
    if len(r):
        yield pa.record_batch([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["r"])


def tsqr(rows: DataFrame, width: int) -> np.ndarray:
    """The triangle ``R`` of ``rows`` of triangles ``r``: levels of ``FAN_IN`` triangles a task, until one is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return triangles((np.array(v.as_py()).reshape(-1, width) for b in batches for v in b.column(0)), width)

    parts = rows.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        rows = rows.repartition(parts).mapInArrow(run, "r array<double>")
    found = rows.collect()  # one triangle
    return np.array(found[0].r).reshape(-1, width) if found else np.zeros((0, width))


def rotations(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """One-sided Jacobi: ``(V, s)`` with ``R V`` of orthogonal columns of lengths ``s``, in falling order.

    A sweep meets every two columns once, in rounds of disjoint pairs that are rotated together; it
    ends when all are orthogonal to working precision. Lengths are those of the rotated columns, so
    small ones keep their relative accuracy, which an eigenvalue of the squared matrix would lose.
    """
    d = r.shape[1]
    a, v = np.array(r, dtype=np.float64), np.eye(d)
    if d % 2:  # a column of zeros makes the number even; it is never rotated
        a, v = np.hstack([a, np.zeros((len(a), 1))]), np.pad(v, ((0, 0), (0, 1)))
    ring = np.arange(a.shape[1])
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            i, j = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            on = np.abs(xy) > len(a) * np.finfo(float).eps * np.sqrt(xx * yy)
            if on.any():
                turned = True
                zeta = (yy[on] - xx[on]) / (2 * xy[on])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c, s = np.ones(len(i)), np.zeros(len(i))
                c[on] = 1 / np.hypot(1, t)
                s[on] = c[on] * t
                for m in (a, v):
                    m[:, i], m[:, j] = c * m[:, i] - s * m[:, j], s * m[:, i] + c * m[:, j]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    lengths = np.sqrt((a[:, :d] ** 2).sum(axis=0))
    order = np.argsort(-lengths, kind="stable")
    return v[:, :d][:, order], lengths[order]


def fit(vectors: DataFrame, column: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> Model | None:
    """Means, components and standard deviations of all valid vectors; None if there is none.

    Three passes over the vectors: their width, exact sums (one row per dimension and task), and the
    triangles of centred rows. What comes to the driver is one sum per dimension and one triangle.
    """
    width = common_width(vectors, column)
    if not width:
        return None
    rows = vectors.select(column)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for b in batches:
            x, _ = integers(b.column(0), width, scale, shift)
            n += len(x)
            total = [t + int(s) for t, s in zip(total, (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object))]
        if n:
            yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([str(t) for t in total])], names=["i", "n", "s"])

    found = rows.mapInArrow(sums, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not found:
        return None
    n, total = found[0].n, tuple(int(r.s) for r in found)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return triangles((centred(integers(b.column(0), width, scale, shift)[0], n, total) for b in batches), width)

    v, s = rotations(tsqr(rows.mapInArrow(compress, "r array<double>"), width))
    return Model(n, total, v, s / np.sqrt(n), float((s**2).sum() / n))


def squares(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sums over dimensions of ``(n x - S)^2``, exact; None where that is no 64-bit integer."""
    most = max((abs(n * int(v) - s) for m in (x.min(axis=0), x.max(axis=0)) for v, s in zip(m, sums)), default=0) if len(x) else 0
    exact = most * most * x.shape[1] < 1 << 63 and n * int(np.abs(x).max(initial=0)) < 1 << 63
    d = n * (x if exact else x.astype(object)) - np.array(sums, dtype=np.int64 if exact else object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def directions(model: Model, most: int) -> np.ndarray:
    """The components to report, divided by their standard deviations; those without any are left out."""
    s = model.deviations
    k = min(most, int((s > s.max(initial=0) * len(s) * np.finfo(float).eps).sum()))
    return model.components[:, :k] / s[:k]


def identity_error(vectors: DataFrame, model: Model, column: str = "embedding", most: int = 32, scale: int = 64, shift: int = 1_000_000) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all of them."""
    width, w = len(model.sums), directions(model, most)
    k = w.shape[1]
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for b in batches:
            y = model.centred(integers(b.column(0), width, scale, shift)[0]) @ w
            total += y.sum(axis=0)
            products += y.T @ y
        yield pa.record_batch([pa.array(range(k + 1), pa.int32()), pa.array([*products.tolist(), total.tolist()], pa.list_(pa.float64()))], names=["i", "v"])

    parts = vectors.select(column).mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    found = {(r.i, r.j): r.v for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}  # k (k + 1) numbers
    mean = np.array([found[k, j] for j in range(k)]) / model.n
    c = np.array([[found[i, j] for j in range(k)] for i in range(k)]) / model.n - np.outer(mean, mean)
    return float(np.abs(c - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Model | None = None, most: int = 32, column: str = "embedding", id_col: str = "vec_id", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row per valid vector and component, up to ``most``.

    Without a ``model`` one is fitted to all valid vectors. Valid are vectors of the width that most
    have (of several the largest) whose entries are finite and, times ``scale``, under 2^53 in size; all others are
    dropped. Components without any variance are left out, so equal vectors, or a single one, give no
    row, nor does an empty table. ``deviation`` is null where its exact value is no 64-bit integer.
    Repeated rows and rows with a null id are rows of their own; other columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = model or fit(vectors, column, scale, shift)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width, w = len(model.sums), directions(model, most)
    k, off = w.shape[1], identity_error(vectors, model, column, most, scale, shift)
    explained = model.deviations[:k] ** 2 / model.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if k else 0, ROWS):
                b = whole.slice(at, ROWS)
                x, ok = integers(b.column(1), width, scale, shift)
                y = model.centred(x) @ w
                each = pa.array(np.repeat(np.arange(len(x)), k))
                deviation = pa.array(squares(x, model.n, model.sums), pa.int64())
                columns = [b.column(0).filter(pa.array(ok)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n)), deviation.take(each), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, off))]
                yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), column).mapInArrow(run, schema)
