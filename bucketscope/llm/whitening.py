"""Whitening of embeddings from exact bit-sliced cross-products (operator 13).

Components become whole numbers (256ths). The scatter of the distinct vectors is worked out on their bits: a task shifts
each dimension to start at zero, packs every bit of it across rows into 64-bit words (a bit plane), and the product sum of
two dimensions is the popcount of each pair of their planes ANDed, weighted by the powers of two of the two bits. A
plane of ones stands for the number 1, so sums and the row count come from the same products. Everything is an exact
whole number until the covariance, centred as such, is handed to the eigensolver.

The driver holds one number per pair of dimensions; rows stay in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.llm.common import in_python, stored

SCALE = 256
COMPONENTS = 4
#: Bytes of the bit planes that a task works on together.
PLANE_BYTES = 16 << 20
LIMB_BITS = 31
LIMBS = 6
LONG = 1 << 63


def whole_numbers(vector: Column) -> Column:
    """Components as 256ths, rounded down. Beyond the range of a long Spark gives its largest or smallest value."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def taking_part(vector: Column) -> Column:
    """Vectors that are not null, of finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def bit_planes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of rows of unsigned numbers as 64-bit words, and the dimension and bit of each plane."""
    count, width = rows.shape
    planes, dimension, bit = [], [], []
    highest = rows.max(axis=0, initial=0)
    for d in range(width):
        for b in range(int(highest[d]).bit_length()):
            planes.append(np.packbits((rows[:, d] >> np.uint64(b)).astype(np.uint8) & 1))
            dimension.append(d)
            bit.append(b)
    words = -(-count // 64)
    packed = np.zeros((len(planes), words * 8), np.uint8)
    for n, plane in enumerate(planes):
        packed[n, : len(plane)] = plane
    return packed.view(np.uint64), np.array(dimension, np.int64), np.array(bit, np.int64)


def bit_products(rows: np.ndarray) -> np.ndarray:
    """Product sums of each two columns of unsigned numbers, as exact Python integers."""
    width = rows.shape[1]
    planes, dimension, bit = bit_planes(rows)
    out = np.zeros((width, width), object)
    if not len(planes):
        return out
    common = np.zeros((len(planes), len(planes)), np.int64)
    for n, plane in enumerate(planes):
        common[n, n:] = np.bitwise_count(planes[n:] & plane).sum(axis=1)
    common += np.triu(common, 1).T
    small = 2 * int(bit.max()) + 2 + int(len(rows)).bit_length() < 62
    number = np.int64 if small else object
    weight = np.array([1 << b for b in bit.tolist()], number)
    weighted = common.astype(number) * weight[:, None] * weight[None, :]
    starts = np.flatnonzero(np.diff(dimension, prepend=-1))
    summed = np.add.reduceat(np.add.reduceat(weighted, starts, axis=0), starts, axis=1)
    used = dimension[starts]
    out[np.ix_(used, used)] = summed.astype(object)
    return out


def cross_products(rows: np.ndarray) -> np.ndarray:
    """Exact product sums of the columns of ``rows`` (longs) and of a column of ones behind them."""
    count, width = rows.shape
    shift = [int(x) for x in rows.min(axis=0)] + [0]
    # the difference of two longs fits in 64 bits without a sign
    shifted = np.ones((count, width + 1), np.uint64)
    shifted[:, :width] = rows.view(np.uint64) - rows.min(axis=0).view(np.uint64)
    own = bit_products(shifted)
    base = np.array(shift, object)
    sums = own[width]
    return own + sums[:, None] * base[None, :] + base[:, None] * sums[None, :] + count * base[:, None] * base[None, :]


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind, copy=False))


def _by_length(batch: pa.RecordBatch, column: pa.Array) -> Iterator[tuple[int, pa.RecordBatch, pa.Array]]:
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    for dim in np.unique(sizes):
        if dim:
            at = pa.array(np.flatnonzero(sizes == dim))
            yield int(dim), batch.take(at), column.take(at)


def scatter(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By length of vector: exact product sums of each two dimensions and of the number 1, behind them, over the rows of
    ``vectors`` (one column ``x`` of longs, none null)."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, column in _by_length(batch, batch.column(0)):
                rows = _matrix(column, dim, np.int64)
                step = max(64, PLANE_BYTES // (dim * 2))  # planes of 16 bits are that large
                for at in range(0, len(rows), step):
                    found = cross_products(rows[at : at + step])
                    totals[dim] = totals[dim] + found if dim in totals else found
        for dim, total in totals.items():
            first, second = np.triu_indices(dim + 1)
            values = total[first, second].tolist()
            # digits of 31 bits, the last with the sign, so that sums over tasks fit in a long
            digits = [[(v >> (LIMB_BITS * n)) & ((1 << LIMB_BITS) - 1) for v in values] for n in range(LIMBS - 1)]
            digits.append([v >> (LIMB_BITS * (LIMBS - 1)) for v in values])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), dim, np.int32)), pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), *[pa.array(d, pa.int64()) for d in digits]],
                names=["dim", "a", "b", *[f"l{n}" for n in range(LIMBS)]],
            )

    digits = [f"l{n}" for n in range(LIMBS)]
    made = in_python(vectors).mapInArrow(add_up, "dim int, a int, b int, " + ", ".join(f"{d} long" for d in digits))
    out: dict[int, np.ndarray] = {}
    # one row per pair of dimensions
    for dim, a, b, *limbs in made.groupBy("dim", "a", "b").agg(*[F.sum(d).alias(d) for d in digits]).toLocalIterator():
        value = sum(limb << (LIMB_BITS * n) for n, limb in enumerate(limbs))
        total = out.setdefault(dim, np.zeros((dim + 1, dim + 1), object))
        total[a, b] = total[b, a] = value
    return out


@dataclass
class Whitening:
    """A fit on vectors of one length: count and sums, and the leading components of the covariance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    rank: int

    @staticmethod
    def of(products: np.ndarray, most: int = COMPONENTS) -> "Whitening":
        dim = len(products) - 1
        n, sums = products[dim, dim], products[:dim, dim]
        centred = n * products[:dim, :dim] - sums[:, None] * sums[None, :]
        square = n * n
        # quotients of whole numbers, each rounded once
        covariance = np.array([[v / square for v in row] for row in centred.tolist()], np.float64)
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1].T
        largest = np.abs(vectors).argmax(axis=1)
        vectors = vectors * np.sign(vectors[np.arange(dim), largest])[:, None]
        # below this an eigenvalue is rounding
        rank = int((values > dim * np.finfo(np.float64).eps * max(values[0], 0)).sum())
        trace = sum(centred[i, i] for i in range(dim)) / square
        share = np.where(np.arange(dim) < rank, values, 0.0) / trace if trace else np.zeros(dim)
        kept = min(most, dim)
        mean = np.array([s / n for s in sums.tolist()])
        return Whitening(n, sums.tolist(), mean, vectors[:kept].copy(), values[:kept].copy(), share[:kept], min(rank, kept))

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Whitened rows; columns beyond the rank are NaN."""
        scale = np.full(len(self.eigenvalues), np.nan)
        scale[: self.rank] = 1 / np.sqrt(self.eigenvalues[: self.rank])
        return (rows - self.mean) @ self.components.T * scale

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2 over the dimensions, exact; None where that is more than a long."""
        reach = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))))
        widest = self.n * reach + max((abs(s) for s in self.sums), default=0)
        if widest * widest * len(self.sums) < LONG:
            apart = self.n * rows - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = self.n * rows.astype(object) - np.array(self.sums, object)
        return [int(v) if v < LONG else None for v in (apart * apart).sum(axis=1)]


def fit(vectors: DataFrame, vector_column: str = "embedding", components: int = COMPONENTS) -> tuple[dict[int, Whitening], dict[int, float]]:
    """By length of vector, its whitening and how far the covariance of its whitened fit list is from the identity.

    The fit list holds each distinct vector of whole numbers once. Tasks merge equal ones before the exchange.
    """
    usable = vectors.where(taking_part(F.col(vector_column)))
    listed = stored(usable.select(whole_numbers(F.col(vector_column)).alias("x")).distinct(), "fit-list")
    fits = {dim: Whitening.of(products, components) for dim, products in scatter(listed).items()}
    return fits, identity_errors(listed, fits)


def identity_errors(listed: DataFrame, fits: dict[int, Whitening]) -> dict[int, float]:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on the fit list."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, column in _by_length(batch, batch.column(0)):
                white = fits[dim].project(_matrix(column, dim, np.int64))[:, : fits[dim].rank]
                white = np.hstack([white, np.ones((len(white), 1))])
                totals[dim] = totals.get(dim, 0) + white.T @ white
        for dim, total in totals.items():
            a, b = np.indices(total.shape)
            columns = [np.full(total.size, dim, np.int32), a.ravel().astype(np.int32), b.ravel().astype(np.int32), total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "a", "b", "total"])

    made = in_python(listed).mapInArrow(add_up, "dim int, a int, b int, total double")
    totals = {dim: np.zeros((f.rank + 1, f.rank + 1)) for dim, f in fits.items()}
    for dim, a, b, total in made.groupBy("dim", "a", "b").agg(F.sum("total")).collect():
        totals[dim][a, b] = total
    out = {}
    for dim, total in totals.items():
        n, rank = fits[dim].n, fits[dim].rank
        mean = total[rank, :rank] / n
        covariance = total[:rank, :rank] / n - np.outer(mean, mean)
        out[dim] = float(np.abs(covariance - np.eye(rank)).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and leading component.

    Vectors that are null or hold null or non-finite entries are left out, and so are empty ones, which have no
    component. Vectors of different lengths are whitened apart, each length by its own fit. A component without variance
    (all vectors equal, or fewer of them than dimensions) has ``explained`` 0 and ``whitened`` null. ``deviation`` is null
    where it is more than a long holds. Rows that repeat an identifier or a vector each have their rows. Other columns are
    not read. An empty table gives no rows.
    """
    fits, errors = fit(vectors, vector_column, components)
    shared = vectors.sparkSession.sparkContext.broadcast((fits, errors))
    rows = vectors.where(taking_part(F.col(vector_column))).select(
        F.col(id_column).alias("vec_id"), whole_numbers(F.col(vector_column)).alias("x")
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, errors = shared.value
        for batch in batches:
            for dim, own, column in _by_length(batch, batch.column(1)):
                found, numbers = fits[dim], _matrix(column, dim, np.int64)
                kept, count = len(found.eigenvalues), len(numbers)
                again = pa.array(np.repeat(np.arange(count), kept))
                deviation = pa.array(found.deviations(numbers), pa.int64()).take(again)
                white = found.project(numbers).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0).take(again),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), count)),
                        pa.array(np.full(len(again), found.n, np.int64)),
                        deviation,
                        pa.array(white, mask=np.isnan(white)),
                        pa.array(np.tile(found.explained, count)),
                        pa.array(np.full(len(again), errors[dim])),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return in_python(rows).mapInArrow(apply, schema)
