"""Embedding whitening from a bit-sliced scatter: exact cross-products by AND and popcount.

A block of rows becomes, per dimension, the bit planes of its entries above the block's least entry; a plane is packed
into 64-bit words across the rows. The sum over rows of the product of two dimensions is then the sum, over pairs of
their planes, of 2^(a+b) times the number of common bits. All sums are integers, also after they are centred; only the
eigenvectors are floating point.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import named, scratch_table

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components returned; the largest size of an entry (beyond it the scaled entry would no longer be exact).
COMPONENTS, LARGEST = 8, 2.0**42
#: Rows of a block (words of a plane: a 64th); bits of the lower parts of a sum that leaves a task.
BLOCK, LIMB = 8192, 40


class Whitening(NamedTuple):
    """``n`` rows, sums per dimension, unit components (a row each), their eigenvalues and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold no null, non-finite or too large entry."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def scaled(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors as whole numbers, without the shift, which no difference needs."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dims)


def planes_of(u: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of the non-negative columns of ``u``: row ``bits * d + a`` holds bit a of dimension d, 64 rows a word."""
    rows, dims = u.shape
    padded = np.zeros((dims, -(-rows // 64) * 64), dtype=np.int64)
    padded[:, :rows] = u.T
    sliced = (padded[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    packed = np.packbits(sliced.astype(np.uint8).reshape(dims * bits, -1), axis=1)
    return packed.view(np.uint64)


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact sums over rows of the products of two columns, as Python integers (upper triangle; the rest is zero).

    With u = x - m for each column's least entry m: sum xy = sum uv + m_v sum u + m_u sum v + rows m_u m_v.
    """
    rows, dims = x.shape
    least = x.min(axis=0)
    u = x - least
    bits = max(1, int(u.max()).bit_length())
    planes = planes_of(u, bits)
    common = np.zeros((dims * bits, dims * bits), dtype=np.int64)
    for p in range(dims * bits):
        first = p // bits * bits  # pairs with earlier dimensions are known
        common[p, first:] = np.bitwise_count(planes[first:] & planes[p]).sum(axis=1, dtype=np.int64)
    shaped = common.reshape(dims, bits, dims, bits)
    exact = np.int64 if 2 * bits + rows.bit_length() < 63 else object
    weights = np.array([1 << a for a in range(bits)], dtype=exact)
    products = np.tensordot(np.tensordot(shaped.astype(exact), weights, ([3], [0])), weights, ([1], [0])).astype(object)
    m, s = least.astype(object), u.sum(axis=0, dtype=np.int64).astype(object)
    return np.triu(products + np.outer(s, m) + np.outer(m, s) + rows * np.outer(m, m))


def _scatter(rows: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums per dimension and cross-products (upper triangle) over the whole table.

    Each task sends one row per pair of dimensions; sums leave it in three parts, so that long columns hold
    them and their totals.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                x = scaled(batch.column(0).slice(at, BLOCK), dims)
                n, sums = n + len(x), sums + x.astype(object).sum(axis=0)
                products = products + cross_products(x)
        if n:
            i, j = np.triu_indices(dims)
            values = [n, *sums, *products[i, j]]
            at = [(-1, -1), *((-1, d) for d in range(dims)), *zip(i.tolist(), j.tolist(), strict=True)]
            limbs = [[int(v) >> 2 * LIMB for v in values], *([int(v) >> s & ((1 << LIMB) - 1) for v in values] for s in (LIMB, 0))]
            columns = [[a for a, _ in at], [b for _, b in at], *limbs]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "j", "high", "mid", "low"])

    parts = rows.mapInArrow(partial, "i long, j long, high long, mid long, low long")
    # One row per pair of dimensions: bounded by the width of the vectors.
    totals = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("high", "mid", "low")]).collect()
    n, sums, products = 0, [0] * dims, np.zeros((dims, dims), dtype=object)
    for i, j, high, mid, low in totals:
        value = (high << 2 * LIMB) + (mid << LIMB) + low
        if i >= 0:
            products[i, j] = value
        elif j >= 0:
            sums[j] = value
        else:
            n = value
    return n, sums, products


def fit_whitening(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Components of all ``vectors`` (one column of usable vectors of ``dims`` entries), by falling eigenvalue.

    The covariance is n * sum xy - (sum x)(sum y), a whole number, over n^2, rounded once. A component without variance
    (an eigenvalue below the rounding error of the largest) has an eigenvalue of exactly zero.
    """
    n, sums, products = _scatter(vectors, dims)
    if not n:
        return Whitening(0, sums, np.zeros((0, dims)), np.zeros(0), 0.0)
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            covariance[i, j] = covariance[j, i] = (n * products[i, j] - sums[i] * sums[j]) / (n * n)
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values = np.where(values[order] > dims * np.finfo(float).eps * max(values.max(), 0.0), values[order], 0.0)
    return Whitening(n, sums, np.ascontiguousarray(columns[:, order].T), values, float(np.trace(covariance)))


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable row of ``df``: a row per row and component, numbered from 1.

    Columns: id, ``component``, ``n``, ``deviation`` (sum over dimensions of (n x - S)^2, exact; null where it passes 64
    bits), ``whitened``, ``explained``, ``identity_error``. Rows whose vector is null or holds a null, non-finite or larger
    entry than LARGEST are left out, empty vectors too; of vectors of several lengths those of the most frequent one
    count (the longer on a tie). A component without variance has null ``whitened`` and takes no part in
    ``identity_error``, which is null if there is no other. Repeated rows and ids are returned each, other columns
    are ignored, an empty table gives no rows.

    The table is read for the lengths, the scatter and the projection; the driver gets one row per pair of dimensions.
    """
    spark = df.sparkSession
    rows = df.select(named(id_col).alias("_id"), named(vector_col).alias("_v")).where(usable(F.col("_v")))
    length = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = length["d"] if length else 1
    rows = rows.where(F.size("_v") == dims)
    model = fit_whitening(rows.select("_v"), dims, components)
    n, k = model.n, len(model.values)
    sums = np.array(model.sums, dtype=object)
    means = np.array([s / n for s in model.sums]) if n else np.zeros(dims)
    spread = np.where(model.values > 0, model.values, np.inf)
    project = (model.components / np.sqrt(spread)[:, None]).T

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                x = scaled(part.column(1), dims)
                far = max(abs(int(x.max()) * n), abs(int(x.min()) * n)) + max(abs(int(s)) for s in sums)
                exact = np.int64 if far * far * dims < 1 << 62 else object
                d = (x.astype(exact) * n - sums.astype(exact)) ** 2
                total = [int(v) if v < 1 << 63 else None for v in d.sum(axis=1)]
                z = (x - means) @ project
                coordinates = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), coordinates], names=["_id", "_d", "_z"])

    id_type = rows.schema["_id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame(
            [], f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    placed = scratch_table(rows.mapInArrow(apply, f"_id {id_type}, _d long, _z array<double>"), "whitened")
    kept = [c for c in range(k) if model.values[c] > 0]
    error = None
    if kept:
        z = [F.get("_z", F.lit(c)) for c in kept]
        centre = placed.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(z)]).first()
        pairs = [(i, j) for i in range(len(kept)) for j in range(i, len(kept))]
        moments = placed.agg(*[(F.sum((z[i] - centre[i]) * (z[j] - centre[j])) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(v - (i == j)) for v, (i, j) in zip(moments, pairs, strict=True))
    explained = [v / model.trace if model.trace > 0 else 0.0 for v in model.values.tolist()]
    each = [
        F.struct(
            F.lit(c + 1).alias("component"), (F.get("_z", F.lit(c)) if c in kept else F.lit(None).cast("double")).alias("whitened"),
            F.lit(explained[c]).alias("explained"),
        )
        for c in range(k)
    ]
    out = placed.select("_id", "_d", F.explode(F.array(*each)).alias("c"))
    return out.select(
        F.col("_id").alias(id_col), "c.component", F.lit(n).cast("long").alias("n"), F.col("_d").alias("deviation"), "c.whitened",
        "c.explained", F.lit(error).cast("double").alias("identity_error"),
    )
