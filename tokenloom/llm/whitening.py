"""Embedding whitening from an exact integer scatter matrix.

Vectors become integers. Each task subtracts a shift and sums its rows and their products exactly: in
doubles where a bound shows that no sum can leave 53 bits, else in Python's integers. Partial sums leave
a task in pieces of 32 bits, which Spark adds up by place as longs, so totals of any size stay exact. Of
these the driver forms n * X'X - S S' (one number for each pair of dimensions) in integers; only that is
turned into floats, and decomposed by eigh. Two more passes project the rows: one measures how far the
whitened rows' covariance is from the identity, one returns them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches

#: Entry c of a vector becomes floor(SCALE * c) + SHIFT. What scales beyond 62 bits is held there.
SCALE, SHIFT, EDGE = 64, 1_000_000, 1 << 62
COMPONENTS = 32
#: The scatter matrix is decomposed on the driver, so vectors may have so many dimensions.
MAX_DIMENSIONS = 1_024
#: Bits of a piece of a partial sum: 2**31 partial sums add up within a long.
PIECE = 32


@dataclass(frozen=True)
class Whitening:
    """Of ``n`` vectors: sums (exact), mean, components (columns), their eigenvalues and shares."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def deviations(self, shifted: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2 for rows of x - SHIFT; null beyond a long's range."""
        off = [s - self.n * SHIFT for s in self.sums]
        wide = max([abs(int(v)) for v in (shifted.max(initial=0), shifted.min(initial=0))]) * self.n + max(map(abs, off), default=0)
        if wide * wide * max(1, self.dimensions) < 1 << 63:
            return ((shifted * self.n - np.array(off, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((shifted.astype(object) * self.n - np.array(off, object)) ** 2).sum(axis=1).tolist()
        return [int(x) if x < 1 << 63 else None for x in exact]

    def whiten(self, shifted: np.ndarray) -> np.ndarray:
        """Rows of x - SHIFT, centred, on the components, over each one's standard deviation. The mean is
        taken off in two steps, whole numbers first, so that large vectors close together keep their digits."""
        whole = [(s - self.n * SHIFT) // self.n for s in self.sums]
        rest = np.array([(s - self.n * SHIFT - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        if all(abs(w) < 1 << 61 for w in whole) and max(abs(int(shifted.max(initial=0))), abs(int(shifted.min(initial=0)))) < 1 << 61:
            centred = (shifted - np.array(whole, np.int64)).astype(np.float64) - rest
        else:
            centred = (shifted.astype(object) - np.array(whole, object)).astype(np.float64) - rest
        return centred @ (self.vectors / np.sqrt(self.values))


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v array<long>): floor(SCALE * c) of each entry c as double, which is x - SHIFT. Null vectors, and those
    with a null or non-finite entry, go."""
    whole = F.col(embedding).cast("array<double>")
    fine = F.forall(whole, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(whole, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(EDGE))), F.lit(-float(EDGE)))).cast("long"))
    return vectors.where(F.col(embedding).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("id"), scaled.alias("v"))


def matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    """Rows of a list column as a matrix; entries that a shorter vector lacks are zero."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends == dimensions).all():
        return values.reshape(len(ends), dimensions)
    out = np.zeros((len(ends), dimensions), np.int64)
    out[np.arange(dimensions)[None, :] < ends[:, None]] = values
    return out


def exact_products(x: np.ndarray) -> np.ndarray:
    """X'X of integer rows, as objects (Python integers)."""
    wide = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    if not len(x) or wide * wide * len(x) >= 1 << 53:
        # Halves of the rows until a sum fits; single rows that do not are multiplied as they are.
        if len(x) > 1 and wide * wide < 1 << 52:
            half = len(x) // 2
            return exact_products(x[:half]) + exact_products(x[half:])
        wholly = x.astype(object)
        return wholly.T @ wholly if len(x) else np.zeros((x.shape[1], x.shape[1]), object)
    doubles = x.astype(np.float64)
    return (doubles.T @ doubles).astype(np.int64).astype(object)


def _pieces(value: int) -> Iterator[tuple[int, int]]:
    """(place, piece) of a number in base 2**PIECE; pieces have its sign."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        yield place, sign * (rest & ((1 << PIECE) - 1))
        rest, place = rest >> PIECE, place + 1


def scatter(rows: DataFrame, dimensions: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, n*X'X - S S') of ``integers``: exact, whatever the size of its numbers.

    A task keeps one matrix; what it sends is one row for each pair of dimensions and piece, and Spark sums
    these before and after the shuffle. What reaches the driver goes by the dimensions alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, [0] * dimensions, np.zeros((dimensions, dimensions), object)
        for b in batches:
            x = matrix(b.column(b.schema.get_field_index("v")), dimensions)
            n += len(x)
            products += exact_products(x)
            wide = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
            part = x.sum(axis=0) if wide * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
            sums = [a + int(p) for a, p in zip(sums, part, strict=True)]
        if not n:
            return
        found = [(-1, -1, 0, n)]
        for i in range(dimensions):
            found += [(i, -1, place, piece) for place, piece in _pieces(sums[i])]
            for j in range(i + 1):
                found += [(i, j, place, piece) for place, piece in _pieces(int(products[i, j]))]
        columns = list(zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "place", "piece"])

    partial = rows.select("v").mapInArrow(released(run), "i int, j int, place int, piece long")
    totals: dict[tuple[int, int], int] = {}
    for i, j, place, piece in partial.groupBy("i", "j", "place").agg(F.sum("piece")).collect():  # by the dimensions, not the rows
        totals[i, j] = totals.get((i, j), 0) + (piece << (PIECE * place))
    n = totals.get((-1, -1), 0)
    off = [totals.get((i, -1), 0) for i in range(dimensions)]
    centred = [[n * totals.get((max(i, j), min(i, j)), 0) - off[i] * off[j] for j in range(dimensions)] for i in range(dimensions)]
    # The covariance is the same with and without the shift.
    return n, [s + n * SHIFT for s in off], centred


def fit(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors; nothing where there are none. Components without variance (to the precision
    of a decomposition in doubles) are no components: fewer come back than asked for."""
    rows = integers(vectors, vec_id, embedding)
    small_batches(vectors.sparkSession, 4_096)
    dimensions = rows.agg(F.max(F.size("v"))).first()[0]
    if dimensions is None:
        return None
    if dimensions > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {dimensions} dimensions; at most {MAX_DIMENSIONS} can be decomposed on the driver")
    n, sums, centred = scatter(rows, dimensions)
    square = n * n
    covariance = np.array([[c / square for c in row] for row in centred], np.float64).reshape(dimensions, dimensions)
    values, found = np.linalg.eigh(covariance) if dimensions else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(initial=0.0), 0.0) * dimensions * np.finfo(np.float64).eps]
    trace = sum(centred[i][i] for i in range(dimensions)) / square
    return Whitening(n, tuple(sums), values[order], found[:, order], values[order] / trace if len(order) else values[order])


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows.
    Tasks send one matrix each; sums are made by Spark, entry by entry."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products, n = np.zeros(k), np.zeros((k, k)), 0
        for b in batches:
            w = model.whiten(matrix(b.column(b.schema.get_field_index("v")), model.dimensions))
            sums, products, n = sums + w.sum(axis=0), products + w.T @ w, n + len(w)
        if n:
            i, j = np.tril_indices(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.arange(k), i]), pa.int32()), pa.array(np.concatenate([np.full(k, -1), j]), pa.int32()), pa.array(np.concatenate([sums, products[i, j]]))], names=["i", "j", "s"]
            )

    found = rows.select("v").mapInArrow(released(run), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect()  # k * (k + 3) / 2 rows
    totals = {(i, j): s for i, j, s in found}
    mean = [totals[i, -1] / model.n for i in range(k)]
    return float(max(abs(s / model.n - mean[i] * mean[j] - (i == j)) for (i, j), s in totals.items() if j >= 0))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error of
    each vector and component.

    All vectors are fitted, and all are returned: rows with a null id among them, and rows given twice.
    Null vectors, and those with a null or non-finite entry, take no part. Entries that a shorter vector
    lacks count as zero; other columns are ignored. A direction without variance is no component, so vectors that
    are all alike, or a single one, give no rows, as does an empty table.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, vec_id, embedding, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    rows = integers(vectors, vec_id, embedding)
    error, k = identity_error(rows, model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for b in batches:
            x = matrix(b.column(b.schema.get_field_index("v")), model.dimensions)
            many, each = len(x) * k, np.repeat(np.arange(len(x)), k)
            columns = [
                b.column(b.schema.get_field_index("id")).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(many, model.n, np.int64)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(model.whiten(x).ravel()),
                pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(many, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(released(run), schema)
