"""Whitening of embeddings from a bit-sliced scatter matrix.

1. Each entry becomes a whole number, ``floor(scale * c) + shift``. A task takes
   its vectors in slices: every dimension, less its least value in the slice, is cut
   into bit planes, and a plane is packed across the rows into 64-bit words. The
   cross-product of two dimensions is the sum of ``2^(a+b) * popcount(plane_a &
   plane_b)``; a plane of ones gives the sums and the count. All of it is exact.
2. A task emits one row per pair of dimensions, as limbs of 32 bits, so that sums
   over any number of tasks fit longs; Spark adds them up by pair. The driver gets
   one row per pair: its share depends on the dimensions, not on the rows.
3. ``n * sum(xy) - sum(x) * sum(y)`` centres the matrix in whole numbers; only then
   is it divided by n^2 and given to ``eigh``.
4. The vectors are read again and projected: whole numbers minus the mean, on the
   components, over the root of the eigenvalue.

Defined cases: vectors that are NULL or hold NULL, NaN or infinite entries are
dropped; of the rest, those that do not have the most frequent length (ties: the
longest) are dropped too. Repeated rows count as often as they occur; a NULL id is an id
like any other. Empty vectors and empty tables give an empty result. Components
whose eigenvalue is zero to double precision (copies of one vector, constant or
dependent dimensions) cannot be scaled to 1 and are left out. ``scale * c`` is held
within +-2^62. ``deviation`` is a decimal of 38 digits, NULL beyond that. A
component's sign makes its largest entry positive. Only the two named columns are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
SLICE_ROWS = 1 << 14  # rows packed at once: a plane of 2 KB
LIMBS = 5
_BOUND = float(1 << 62)
_DIGITS = 10 ** 38
_LONG = 1 << 63


@dataclass
class Components:
    """What ``eigh`` gave: ``sums`` of the n whole-number vectors, unit ``axes`` (a
    column each), eigenvalues ``scale``, shares ``explained``."""
    n: int
    sums: list[int]
    axes: np.ndarray
    scale: np.ndarray
    explained: np.ndarray
    identity_error: float


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): doubles, without vectors that are NULL or hold NULL or non-finite entries."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where("v is not null").where(finite)


def whole_numbers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """(rows, dims) int64 of the column v."""
    v = batch.column("v")
    c = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dims)
    return np.clip(np.floor(SCALE * c), -_BOUND, _BOUND).astype(np.int64) + SHIFT


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of the columns of ``y`` (uint64): packed words, and the column and the
    bit of each plane, ordered by column."""
    bits = [int(m).bit_length() for m in y.max(axis=0)]
    column = np.repeat(np.arange(y.shape[1]), bits)
    bit = np.concatenate([np.arange(b) for b in bits]).astype(np.uint64)
    words = np.zeros((len(column), -(-len(y) // 64)), np.uint64)
    for k, (c, b) in enumerate(zip(column, bit)):
        packed = np.packbits(((y[:, c] >> b) & np.uint64(1)).astype(np.uint8))
        words[k].view(np.uint8)[:len(packed)] = packed
    return words, column, bit


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact ``x1.T @ x1`` (Python integers) by popcounts, x1 being x and a column of ones."""
    rows, dims = x.shape
    least = x.min(axis=0)
    y = np.ones((rows, dims + 1), np.uint64)
    y[:, :dims] = (x - least).astype(np.uint64)
    words, column, bit = bit_planes(y)
    together = np.zeros((len(words), len(words)), np.int64)
    for k in range(len(words)):
        together[k, k:] = np.bitwise_count(words[k] & words[k:]).sum(axis=1, dtype=np.int64)
    together = np.triu(together) + np.triu(together, 1).T
    small = 2 * (int(bit.max()) + 1) + rows.bit_length() < 63
    weight = np.array([1 << int(b) for b in bit], np.int64 if small else object)
    used, heads = np.unique(column, return_index=True)
    half = np.add.reduceat(together.astype(weight.dtype) * weight, heads, axis=1)
    held = np.add.reduceat(half * weight[:, None], heads, axis=0).astype(object)
    out = np.zeros((dims + 1, dims + 1), object)
    out[np.ix_(used, used)] = held
    base = np.array([int(m) for m in least] + [0], object)
    sums = out[:, dims].copy()
    return out + np.outer(base, sums) + np.outer(sums, base) + rows * np.outer(base, base)


def scatter_rows(dims: int):
    """``mapInArrow`` function: a row (i, j, l0..l4) for each pair i <= j of a task."""
    at_i, at_j = np.triu_indices(dims + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest = 0, []
        for batch in batches:
            rest.append(whole_numbers(batch, dims))
            while sum(map(len, rest)) >= SLICE_ROWS:
                x = np.concatenate(rest)
                total, rest = total + cross_products(x[:SLICE_ROWS]), [x[SLICE_ROWS:]]
        if sum(map(len, rest)):
            total = total + cross_products(np.concatenate(rest))
        if isinstance(total, int):
            return
        values = total[at_i, at_j]
        limbs = [[int(v) >> 32 * k & 0xFFFFFFFF for v in values] for k in range(LIMBS - 1)]
        limbs.append([int(v) >> 32 * (LIMBS - 1) for v in values])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at_i, pa.int32()), pa.array(at_j, pa.int32()), *(pa.array(p, pa.int64()) for p in limbs)],
            names=["i", "j", *(f"l{k}" for k in range(LIMBS))])
    return run


def scatter(vectors: DataFrame, dims: int) -> np.ndarray:
    """The (dims + 1) x (dims + 1) matrix of exact sums over all rows (the last index
    stands for ones), as Python integers."""
    names = [f"l{k}" for k in range(LIMBS)]
    parts = vectors.select("v").mapInArrow(
        scatter_rows(dims), "i int, j int, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((dims + 1, dims + 1), object)
    for r in parts.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[r.i, r.j] = out[r.j, r.i] = sum(r[n] << 32 * k for k, n in enumerate(names))
    return out


def components(sums: np.ndarray, most: int = COMPONENTS) -> Components | None:
    """Components of the covariance, centred as whole numbers. None without rows."""
    n = int(sums[-1, -1]) if len(sums) else 0
    if not n:
        return None
    s = [int(v) for v in sums[:-1, -1]]
    centred = [[n * int(sums[i, j]) - s[i] * s[j] for j in range(len(s))] for i in range(len(s))]
    cov = np.array([[a / (n * n) for a in row] for row in centred])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(values[-1], 0.0) * len(s) * np.finfo(float).eps]
    e, u = values[order], vectors[:, order]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(len(e))])
    trace = sum(centred[i][i] for i in range(len(s))) / (n * n)
    white = u.astype(np.longdouble) / np.sqrt(e.astype(np.longdouble))
    off = white.T @ cov.astype(np.longdouble) @ white - np.eye(len(e))
    error = float(np.abs(off).max()) if len(e) else 0.0
    return Components(n, s, u, e, e / trace if trace else e, error)


def projection(model: Components):
    """``mapInArrow`` function: id, deviation (text) and whitened of each vector."""
    n, dims = model.n, len(model.sums)
    near = [(2 * s + n) // (2 * n) for s in model.sums]  # whole numbers next to the mean
    left = [s - n * m for s, m in zip(model.sums, near)]
    mean = np.array([r / n for r in left])
    axes = model.axes / np.sqrt(model.scale)
    fixed, total = sum(r * r for r in left), sum(map(abs, left))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch, dims)
            large = max(map(abs, near)) + int(np.abs(x).max(initial=0)) >= _LONG >> 1
            y = x.astype(object if large else np.int64) - np.array(near, object if large else np.int64)
            wide = int(abs(y).max(initial=0))
            if max(wide * dims, total) * wide >= _LONG:
                y = y.astype(object)
            square = (y * y).sum(axis=1)
            cross = (y * np.array(left, y.dtype)).sum(axis=1)
            deviation = [n * n * int(q) - 2 * n * int(p) + fixed for q, p in zip(square, cross)]
            white = (y.astype(float) - mean) @ axes
            offsets = np.arange(len(x) + 1, dtype=np.int32) * axes.shape[1]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"),
                pa.array([Decimal(d) if d < _DIGITS else None for d in deviation], pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel()))],
                names=["id", "deviation", "whitened"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS
           ) -> DataFrame:
    """One row per remaining vector: id, n, deviation (decimal), whitened and
    explained (arrays, components by falling eigenvalue), identity_error."""
    usable = usable_vectors(vectors, id_col, vector_col)
    id_type = dict(usable.dtypes)["id"]
    length = (usable.groupBy(F.size("v").alias("dims")).count()
              .orderBy(F.desc("count"), F.desc("dims")).first())
    dims = length.dims if length else 0
    usable = usable.where(F.size("v") == dims)
    model = components(scatter(usable, dims), most) if dims else None
    if model is None:
        rows = usable.limit(0).select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"),
                                      F.col("v").alias("whitened"))
        model = Components(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    else:
        rows = usable.mapInArrow(projection(model), f"id {id_type}, deviation decimal(38,0), whitened array<double>")
    explained = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    return rows.select(F.col("id").alias(id_col), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def whitened_rows(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component. ``deviation`` as a long (NULL beyond it)."""
    long = whitened.select(
        id_col, "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("component", "at"))
    return long.select(id_col, (F.col("component") + 1).alias("component"), "n", "deviation",
                       F.col("at.whitened").alias("whitened"), F.col("at.explained").alias("explained"),
                       "identity_error")
