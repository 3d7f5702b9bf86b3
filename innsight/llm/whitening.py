"""Whitening of embeddings from exact integer covariances.

1. Entries become integers (``floor(scale * c) + offset``); the fit list holds each
   distinct integer vector once.
2. Per dimension, the least value over the fit list is its shift: what is left
   has few bits.  The rows of a batch are turned into bit planes, one per
   dimension and bit, packed across rows into 64-bit words.  A cross-product of
   two dimensions is the sum over their planes of the population count of the
   planes' AND, weighted by the bits' places (bit-sliced scatter).  It is exact;
   per task and pair of dimensions one number is shuffled and added up.
3. The driver gets one integer per pair of dimensions (dimensions squared, at
   any number of rows), centres them as integers (n C - S S') and divides by n
   squared only then; ``eigh`` gives the components.
4. Rows are projected where they are.

Defined results: rows whose vector is NULL, empty or holds NULL or non-finite entries take
no part, nor do vectors of another length than the most frequent one (of equally
frequent ones the longest); NULL vec_ids and repeated rows are rows like others; components without
variance (eigenvalue up to 1e-12 of the largest) cannot be whitened and are left out,
so a fit list of one vector gives no rows, as an empty table does.  A result
beyond a long raises an error.  Further columns are not carried.  Of the two signs of a component the one whose
largest entry is positive is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.common import ship, stage

#: Rows whose planes are held at once.
ROWS = 16_384
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    inf = F.lit(float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)), F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch], d: int, most: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their integer vectors as a matrix), ``most`` rows at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            part = batch.slice(i, most)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def bit_planes(u: np.ndarray, bits: int) -> np.ndarray:
    """Planes [bit, dimension, word] of a matrix [row, dimension] of integers of at most ``bits`` bits."""
    rows, d = u.shape
    out = np.zeros((bits, d, -(-rows // 64) * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((u >> b) & 1).astype(np.uint8).T, axis=1)
        out[b, :, : packed.shape[1]] = packed
    return out.view(np.uint64)


def scatter(u: np.ndarray, bits: int) -> list[list[int]]:
    """Exact cross-products (dimension by dimension) of a matrix of non-negative integers."""
    d = u.shape[1]
    planes = bit_planes(u, bits)
    flat = planes.reshape(bits * d, -1)
    total = np.zeros((d, d), object)
    narrow = 2 * bits + int(u.shape[0]).bit_length() < 62
    for a in range(bits):
        # planes a and b of dimensions i and j; what b < a gives is its mirror image
        counts = np.stack([np.bitwise_count(planes[a, i] & flat[a * d :]).sum(axis=1, dtype=np.int64) for i in range(d)]).reshape(d, bits - a, d)
        part = np.zeros((d, d), np.int64 if narrow else object)
        for b in range(a, bits):
            c = counts[:, b - a, :] if narrow else counts[:, b - a, :].astype(object)
            both = c if a == b else c + c.T
            part = part + both * (1 << (a + b))
        total = total + part.astype(object)
    return total.tolist()


def _ranges(fit: DataFrame, d: int) -> tuple[int, list[int], list[int], list[int]]:
    """(rows, sums, least and greatest value of each dimension); one number per task and dimension is shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, low, high = 0, [0] * d, None, None
        for _, x in _blocks(batches, d):
            if len(x):
                n += len(x)
                shift = x.min(axis=0)
                wide = (x.max(axis=0).astype(object) - shift.astype(object)).max() >= 1 << 40
                over = (x.astype(object) - shift).sum(axis=0) if wide else (x - shift).sum(axis=0)
                s = [a + int(b) + len(x) * int(c) for a, b, c in zip(s, over, shift, strict=True)]
                low = shift if low is None else np.minimum(low, shift)
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d, dtype=np.int32)), pa.array([n] * d, pa.int64()), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0)), pa.array(low), pa.array(high)],
                ["i", "n", "s", "low", "high"])

    parts = fit.mapInArrow(partial, "i int, n bigint, s decimal(38,0), low bigint, high bigint")
    rows = sorted(parts.groupBy("i").agg(F.sum("n"), F.sum("s"), F.min("low"), F.max("high")).collect())
    if not rows:
        return 0, [], [], []
    return rows[0][1], [int(r[2]) for r in rows], [r[3] for r in rows], [r[4] for r in rows]


def _products(fit: DataFrame, d: int, low: list[int], bits: int) -> list[list[int]]:
    """Cross-products of the shifted dimensions over the whole fit list."""
    shift = np.array(low, np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, d):
            if len(x):
                made = np.array(scatter((x - shift).astype(np.uint64), bits), object)
                total = made if total is None else total + made
        if total is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "v"])

    parts = fit.mapInArrow(partial, "i int, j int, v decimal(38,0)")
    out = [[0] * d for _ in range(d)]
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():  # dimensions squared
        out[i][j] = out[j][i] = int(v)
    return out


def _projection(n: int, sums: list[int], low: list[int], products: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, each over the root of its eigenvalue; shares of the trace)."""
    d = len(sums)
    s = [a - n * b for a, b in zip(sums, low, strict=True)]  # of the shifted dimensions
    v = np.array([[(n * products[i][j] - s[i] * s[j]) / (n * n) for j in range(d)] for i in range(d)], float)  # integers until the division
    e, c = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")
    order = order[e[order] > max(1e-12 * e[order[0]], 0)][:most]
    e, c = e[order], c[:, order]
    c = c * np.where(c[np.abs(c).argmax(axis=0), np.arange(len(e))] < 0, -1.0, 1.0)
    return c / np.sqrt(e), e / np.trace(v)


def _whitened(x: np.ndarray, n: int, sums: list[int], w: np.ndarray) -> np.ndarray:
    # whole parts first: what is left is small, so nothing is lost to the size of x
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return ((x - whole).astype(float) - rest) @ w


def _identity_error(fit: DataFrame, n: int, sums: list[int], w: np.ndarray) -> float:
    """Largest entry of the covariance of the whitened fit list, less the identity; measured on the rows."""
    d, k = w.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, one = np.zeros((k, k)), np.zeros(k)
        for _, x in _blocks(batches, d):
            z = _whitened(x, n, sums, w)
            total += z.T @ z
            one += z.sum(axis=0)
        both = np.vstack([total, one])
        i, j = np.divmod(np.arange((k + 1) * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both.ravel())], ["i", "j", "v"])

    got = np.zeros((k + 1, k))
    for i, j, v in fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        got[i, j] = v
    mean = got[k] / n
    return float(np.abs(got[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``SCHEMA`` for each usable row of (vec_id, embedding) and each of the first ``components`` components."""
    spark = vectors.sparkSession
    ship(spark)
    entry = lambda c: F.floor(c.cast("double") * scale) + offset
    rows = vectors.where(finite(F.col("embedding")) & (F.size("embedding") > 0)).select(F.col("vec_id").cast("bigint"), F.transform("embedding", entry).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], SCHEMA)
    d = lengths.d
    rows = rows.where(F.size("x") == d)
    fit = stage(rows.select("x").distinct(), "fit-list")
    n, sums, low, high = _ranges(fit, d)
    bits = max(1, max(b - a for a, b in zip(low, high, strict=True)).bit_length())
    w, share = _projection(n, sums, low, _products(fit, d, low, bits), components)
    if not len(share):
        return spark.createDataFrame([], SCHEMA)
    error = _identity_error(fit, n, sums, w)
    # deviations in longs where none can leave them
    far = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums, strict=True))
    fits = d * far * far < 1 << 63
    k = len(share)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, d, 4_096):
            m = len(x)
            off = x * np.int64(n) - np.array(sums, np.int64) if fits else x.astype(object) * n - np.array(sums, object)
            deviation = (off * off).sum(axis=1)
            values = pa.array(deviation if fits else [int(v) for v in deviation], pa.int64())
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                 values.take(again), pa.array(_whitened(x, n, sums, w).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, SCHEMA)
