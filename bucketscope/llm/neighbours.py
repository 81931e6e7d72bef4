"""Approximate nearest neighbours by cross-polytope hashing (operator 2).

Each table turns the unit vectors by a pseudo-rotation, three rounds of random signs and a fast Hadamard transform, and
puts a vector in the bucket of its nearest signed axis. A query looks in the buckets of its nearest axes of every table.
Buckets are joined as blocks: queries and candidates of one bucket meet in one numpy task, and a bucket too large for
that is cut into pieces of bounded size, each of which meets every piece of queries. Candidates are ranked by the exact
cosine of the original vectors. Queries that find too few candidates are compared with all rows, in blocks too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketscope.llm.common import in_python, stored

TABLES = 8
#: Axes per table that a query looks at, of two times the dimension.
PROBES = 16
NEIGHBOURS = 5
#: Rows of a block.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 512
ROUNDS = 3


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    count, width = rows.shape
    half = 1
    while half < width:
        pairs = rows.reshape(count, width // (2 * half), 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(count, width)
        half *= 2
    return rows / np.sqrt(width)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two next to their largest component, which changes no cosine: squares of it neither
    overflow nor vanish."""
    exponents = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1]
    return np.ldexp(vectors, -exponents[:, None])


def rotated(vectors: np.ndarray, table: int, seed: int) -> np.ndarray:
    width = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    rows = np.zeros((len(vectors), width))
    rows[:, : vectors.shape[1]] = vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (ROUNDS, width))
    for sign in signs:
        rows = hadamard(rows * sign)
    return rows


def nearest_axes(vectors: np.ndarray, table: int, seed: int, probes: int = 1) -> np.ndarray:
    """The ``probes`` nearest signed axes of each vector, nearest first: axis i, or width + i for its negative."""
    turned = rotated(vectors, table, seed)
    signed = np.concatenate([-turned, turned], axis=1)  # ascending order of distance to +i, then -i
    return np.argsort(signed, axis=1, kind="stable")[:, :probes]


def usable(vector: Column) -> Column:
    """Vectors that take part: not null or empty, all components finite, length above zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def bucketed(rows: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """``id, vector, dim, place, bucket``: a row per table (``place``) and bucket looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(1)])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                own = batch.take(pa.array(at))
                vectors = scaled(_matrix(own.column(1)).astype(np.float64))
                for place in range(tables):
                    axes = nearest_axes(vectors, place, seed, probes)
                    n = axes.shape[1]
                    again = pa.array(np.repeat(np.arange(len(at)), n))
                    yield pa.RecordBatch.from_arrays(
                        [
                            own.column(0).take(again), own.column(1).take(again),
                            pa.array(np.full(len(again), dim, np.int32)), pa.array(np.full(len(again), place, np.int32)),
                            pa.array(axes.ravel().astype(np.int32)),
                        ],
                        ["id", "vector", "dim", "place", "bucket"],
                    )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return in_python(rows).mapInArrow(run, f"{kinds}, dim int, place int, bucket int")


def exact_scores(queries: np.ndarray, others: np.ndarray, own_rows: np.ndarray, other_rows: np.ndarray) -> np.ndarray:
    """Cosines of the rows in pairs, each summed from the first component to the last: equal vectors get equal scores."""
    lengths = [np.zeros(len(queries)), np.zeros(len(others))]
    dot = np.zeros(len(own_rows))
    for i in range(queries.shape[1]):
        dot += queries[own_rows, i] * others[other_rows, i]
        lengths[0] += queries[:, i] ** 2
        lengths[1] += others[:, i] ** 2
    own, other = (np.sqrt(x) for x in lengths)
    return dot / (own[own_rows] * other[other_rows])


def _best_in_block(k: int):
    """The ``k`` best identifiers of each query row: rows of one identifier count once, by their best score, before the cut."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        query_ids, ids = (t.column("id").to_numpy() for t in (queries, rows))
        if not len(query_ids) or not len(ids):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, c = (scaled(_matrix(t.column("vector")).astype(np.float64)) for t in (queries, rows))
        by_id = np.argsort(ids, kind="stable")
        ids, c = ids[by_id], c[by_id]
        about = (q / np.sqrt((q**2).sum(axis=1))[:, None]) @ (c / np.sqrt((c**2).sum(axis=1))[:, None]).T
        about[query_ids[:, None] == ids[None, :]] = -np.inf
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        # the best row of each identifier, as a column per identifier
        best = about if len(starts) == len(ids) else np.maximum.reduceat(about, starts, axis=1)
        if len(starts) > k:
            floor = -np.partition(-best, k - 1, axis=1)[:, k - 1 : k]
            pairs = np.nonzero((about >= floor - 1e-9) & (about > -np.inf))
        else:
            pairs = np.nonzero(about > -np.inf)
        score = exact_scores(q, c, *pairs)
        row, vec_id = pairs[0], ids[pairs[1]]
        order = np.lexsort((-score, vec_id, row))
        row, vec_id, score = row[order], vec_id[order], score[order]
        once = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (vec_id[1:] != vec_id[:-1])])[: len(row)])
        row, vec_id, score = row[once], vec_id[once], score[once]
        order = np.lexsort((vec_id, -score, row))
        row, vec_id, score = row[order], vec_id[order], score[order]
        first = np.searchsorted(row, np.arange(len(query_ids)))
        top = np.arange(len(row)) - first[row] < k
        return pa.table({"query_id": query_ids[row[top]], "vec_id": vec_id[top], "score": score[top]})

    return run


def _joined_blocks(queries: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` nearest rows of each query within each key, found in blocks of bounded size."""
    # a row per key; keys are dimensions, tables and axes, not data
    both = rows.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / BLOCK_ROWS) + 1).cast("int").alias("pieces"))
    asked = queries.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / BLOCK_QUERIES) + 1).cast("int").alias("parts"))
    cut = F.broadcast(both.join(asked, keys))
    # by vector too: the rows of an identifier with many vectors are spread
    salt = F.xxhash64("id", "vector")
    piece, part = F.pmod(salt, F.col("pieces")), F.pmod(salt, F.col("parts"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = [*keys, "piece", "part"]
    q = queries.join(cut, keys).select("id", "vector", *keys, part.cast("int").alias("part"), spread("pieces").alias("piece"))
    c = rows.join(cut, keys).select("id", "vector", *keys, piece.cast("int").alias("piece"), spread("parts").alias("part"))
    found = in_python(q).groupBy(*block).cogroup(c.groupBy(*block)).applyInArrow(_best_in_block(k), "query_id long, vec_id long, score double")
    # a pair found in several tables has the same score in each
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = NEIGHBOURS,
    tables: int = TABLES,
    probes: int = PROBES,
    seed: int = 2,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the ``k`` nearest of the other rows that were found.

    Ties go to the smaller identifier. With fewer than ``k`` other rows, all are returned. Rows with a null identifier,
    and vectors that are null, empty, zero or hold null or non-finite components, take no part; vectors of different
    dimensions are never compared. Rows that repeat an identifier count as one row of it, with the best score that any
    of their vectors has, and are no neighbours of themselves. An empty table gives no rows. Other columns are not read.
    """
    taking_part = vectors.where(usable(F.col(vector_column)) & F.col(id_column).isNotNull())
    named = [F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")]
    # rows equal in both are one; tasks merge them before the exchange
    rows, asking = taking_part.select(*named).distinct(), taking_part.where(is_query).select(*named).distinct()
    keys = ["dim", "place", "bucket"]
    indexed = stored(bucketed(rows, tables, 1, seed), "index")
    probing = bucketed(asking, tables, probes, seed)
    found = stored(_joined_blocks(probing, indexed, keys, k), "neighbours")
    enough = found.groupBy("query_id").count().where(F.col("count") >= k)
    short = asking.join(enough, asking["id"] == enough["query_id"], "left_anti").withColumn("dim", F.size("vector"))
    if not short.isEmpty():
        exact = _joined_blocks(short, rows.withColumn("dim", F.size("vector")), ["dim"], k)
        found = found.join(enough, "query_id", "left_semi").unionByName(exact)
    return found.select("query_id", "rank", "vec_id", "score")
