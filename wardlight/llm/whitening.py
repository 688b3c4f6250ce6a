"""Operator 13: whitening of embeddings from an exact scatter matrix, by bit slices.

Entries become whole numbers, floor(64 c). A block of distinct vectors is shifted by its
own minima, and every bit plane of every dimension is packed across the rows into
64-bit words. The popcount of two planes' AND, weighted with both powers of two, summed
over planes, is the exact product sum of two dimensions; the shift is put back in whole numbers.
Tasks send one row per pair of dimensions; the sums are centred as whole numbers,
n * sum(xy) - sum(x) sum(y), before eigenvectors are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.stored import discard, store

SCALE, OFFSET = 64, 1_000_000   # fixed: x = floor(SCALE * c) + OFFSET
COMPONENTS = 16
BLOCK = 4096                    # vectors sliced at once
LIMIT = float(2 ** 60)          # larger steps are cut to it
LIMB = 2 ** 60                  # sums travel as two decimals, high * LIMB + low
NULL_EIGENVALUE = 1e-13         # of the largest: below it a component has no direction


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, lengths, steps end to end) of the usable vectors of a list column, steps being floor(64 c)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets, dtype=np.int64))
    lengths[np.asarray(column.is_null())] = 0
    entries = column.flatten()
    values = np.asarray(entries.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(lengths)
    usable = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    with np.errstate(over="ignore"):
        steps = np.clip(np.floor(values[np.repeat(usable, lengths)] * SCALE), -LIMIT, LIMIT).astype(np.int64)
    return np.flatnonzero(usable), lengths[usable], steps


def _distinct(embeddings: DataFrame, vec_col: str) -> DataFrame:
    """length and x (64-bit steps as bytes) of each distinct usable vector."""
    def packed(batches):
        for batch in batches:
            _, lengths, steps = _whole(batch.column(0))
            ends = np.concatenate([[0], np.cumsum(lengths)]) * 8
            x = pa.Array.from_buffers(pa.binary(), len(lengths), [
                None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(steps.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(lengths.astype(np.int32)), x], names=["length", "x"])

    return embeddings.select(F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(packed, "length int, x binary").distinct()


def sliced_products(x: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of the products of all pairs of columns of non-negative whole numbers.

    Bit b of column i, packed across the rows, ANDed with bit c of column j and counted, has weight 2 ** (b + c).
    """
    bits = np.maximum([int(top).bit_length() for top in x.max(axis=0)], 1)
    column, bit = np.repeat(np.arange(x.shape[1]), bits), np.concatenate([np.arange(b) for b in bits])
    planes = np.packbits((x.T[column] >> bit[:, None] & 1).astype(np.uint8), axis=1)
    planes = np.pad(planes, ((0, 0), (0, -planes.shape[1] % 8))).view(np.uint64)
    exact = np.int64 if 2 * int(bits.max()) + len(x).bit_length() <= 62 else object
    weight = np.array([1 << int(b) for b in bit], dtype=exact)
    starts = np.concatenate([[0], np.cumsum(bits)[:-1]])
    products = np.zeros((len(bits), len(bits)), dtype=exact)
    for i, start in enumerate(starts):   # one column's planes against its own and all later ones
        own = slice(start, start + bits[i])
        counts = np.stack([np.bitwise_count(plane & planes[start:]).sum(axis=1, dtype=np.int64) for plane in planes[own]])
        summed = (counts.astype(exact) * weight[own, None]).sum(axis=0) * weight[start:]
        products[i, i:] = products[i:, i] = np.add.reduceat(summed, starts[i:] - start)
    return products


def _scatter(size: int):
    """Batches of packed vectors to rows (i, j, high, low): product sums, with j = -1 sums, with i = -1 the count."""
    def sums(batches):
        total, first, n = np.zeros((size, size), dtype=object), np.zeros(size, dtype=object), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                x = np.frombuffer(b"".join(batch.column(0).slice(start, BLOCK).to_pylist()), dtype=np.int64).reshape(-1, size)
                low = x.min(axis=0)
                shift = low.astype(object)
                above = x - low   # steps are at most 2 ** 60, so differences fit
                some = above.astype(object).sum(axis=0) if above.max() > 2 ** 40 else above.sum(axis=0).astype(object)
                cross = np.outer(shift, some)
                total += sliced_products(above).astype(object) + cross + cross.T + len(x) * np.outer(shift, shift)
                first += some + len(x) * shift
                n += len(x)
        rows = [(-1, -1, n), *((i, -1, first[i]) for i in range(size)),
                *((i, j, total[i, j]) for i in range(size) for j in range(i, size))] if n else []
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
            pa.array([str(int(r[2]) // LIMB) for r in rows], pa.string()),
            pa.array([str(int(r[2]) % LIMB) for r in rows], pa.string())], names=["i", "j", "high", "low"])

    return sums


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors of ``size`` steps, exact sums of steps, unit eigenvectors as columns, and eigenvalues."""

    n: int
    size: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list | np.ndarray]:
        """(x - S / n as doubles, exact sums of (n x - S) ** 2, None where beyond 64 bits) of rows of steps.

        Offsets cancel: n x - S is the same for steps and steps + OFFSET.
        """
        sums = np.array(self.sums, dtype=object)
        widest = max((abs(self.n * int(v) - s) for row in (x.min(axis=0), x.max(axis=0)) for v, s in zip(row, self.sums, strict=True)))
        fits = self.size * widest ** 2 < 2 ** 63 and self.n * int(np.abs(x).max()) < 2 ** 62 and all(abs(s) < 2 ** 62 for s in self.sums)
        apart = self.n * x - sums.astype(np.int64) if fits else self.n * x.astype(object) - sums
        spread = (apart * apart).sum(axis=1)
        return (apart / self.n).astype(np.float64), spread if fits else [int(s) if s < 2 ** 63 else None for s in spread]

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened values; not a number for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (centred @ self.vectors) / np.sqrt(self.values), np.nan)


def _decompose(n: int, size: int, sums: list[int], products: dict, components: int) -> Whitening:
    scatter = [[n * products[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    covariance = np.array([[entry / (n * n) for entry in row] for row in scatter])   # division of whole numbers rounds once
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = sum(scatter[i][i] for i in range(size)) / (n * n)
    values = np.where(values > NULL_EIGENVALUE * max(values[0], 0.0), values, 0.0)
    return Whitening(n, size, tuple(sums), vectors * signs, values, values / trace if trace else np.zeros_like(values))


def fit(embeddings: DataFrame, components: int = COMPONENTS, vec_col: str = "embedding") -> Whitening | None:
    """Whitening of each distinct vector once; None without a usable vector.

    Vectors that are null, empty, or hold a null or non-finite entry are left out; so are those of another
    length than most distinct vectors have (the longer, on a tie). Steps beyond 2 ** 60 are cut there. Copies are merged before
    the shuffle. Sums are exact at every size; the driver gets (size + 1)(size + 2) / 2 numbers, once.
    identity_error is measured on the whitened vectors themselves in a second pass over the distinct ones.
    """
    spark = embeddings.sparkSession
    distinct = store(spark, _distinct(embeddings, vec_col), "whitening-vectors")
    lengths = distinct.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None:
        discard(distinct)
        return None
    size = lengths["length"]
    vectors = distinct.filter(F.col("length") == size).select("x")
    rows = vectors.mapInArrow(_scatter(size), "i int, j int, high string, low string").groupBy("i", "j").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    found = {(r.i, r.j): int(r.high) * LIMB + int(r.low) for r in rows}
    model = _decompose(found[-1, -1], size, [found[i, -1] for i in range(size)], found, components)

    def second_moments(batches):
        total, n = np.zeros((len(model.values) + 1, len(model.values) + 1)), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                x = np.frombuffer(b"".join(batch.column(0).slice(start, BLOCK).to_pylist()), dtype=np.int64).reshape(-1, size)
                white = np.column_stack([model.project(model.centred(x)[0]), np.ones(len(x))])
                total += white.T @ white
                n += len(x)
        if n:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([
                pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    moments = np.zeros((len(model.values) + 1, len(model.values) + 1))
    for row in vectors.mapInArrow(second_moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        moments[row.i, row.j] = row.s / model.n
    discard(distinct)
    means = moments[-1, :-1]
    real = model.values > 0
    error = np.abs(moments[:-1, :-1] - np.outer(means, means) - np.eye(len(means)))[np.ix_(real, real)]
    return Whitening(model.n, size, model.sums, model.vectors, model.values, model.explained, float(error.max()) if real.any() else None)


SCHEMA = "{id} bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable row and component (at most the vector's length): component, n, deviation, whitened, explained, identity_error.

    Rows that ``fit`` leaves out have none; without a model there are none. Repeated rows and
    null ids are projected like any other; extra columns are not read. A component without variance has
    a null whitened value and explained 0. deviation is null where it exceeds 64 bits.
    """
    schema = SCHEMA.format(id=id_col)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    names = [field.split()[0] for field in schema.split(", ")]
    count = len(model.values)

    def projected(batches):
        for batch in batches:
            rows, lengths, steps = _whole(batch.column(1))
            fits = lengths == model.size
            rows, x = rows[fits], steps[np.repeat(fits, lengths)].reshape(-1, model.size)
            for start in range(0, len(x), BLOCK):
                centred, spread = model.centred(x[start:start + BLOCK])
                white = model.project(centred).ravel()
                repeat = np.repeat(np.arange(len(centred)), count)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(rows[start:start + BLOCK], count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(centred))),
                    pa.array(np.full(len(white), model.n, dtype=np.int64)), pa.array(spread, pa.int64()).take(pa.array(repeat)),
                    pa.array(white, mask=np.isnan(white)), pa.array(np.tile(model.explained, len(centred))),
                    pa.array([model.identity_error] * len(white), pa.float64())], names=names)

    vectors = embeddings.select(F.col(id_col).cast("bigint").alias(id_col), F.col(vec_col).cast("array<double>").alias("v"))
    return vectors.mapInArrow(projected, schema)
