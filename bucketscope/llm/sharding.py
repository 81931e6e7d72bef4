"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (operator 1).

How many rows each input partition sends to each destination is drawn first, from the distribution that a uniform
permutation of all rows would give. Then each partition permutes its rows and deals them out by these counts, the rows
are exchanged, and each destination permutes what it received. A destination is a block: a shard is cut into blocks of
exact sizes, so that a large shard is not permuted in one task, and the slot of a row follows from its block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketscope.llm.common import free_name, in_python, stored

#: Bounds of the matrix: rows (input partitions, joined beyond that) and columns (blocks), 8 bytes a cell.
MAX_PARTS = 4096
MAX_BLOCKS = 2048
#: Rows of a block, as long as MAX_BLOCKS allows.
BLOCK_ROWS = 1 << 16
#: Beyond this many rows numpy refuses to draw.
NUMPY_ROWS = 10**9


def draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric number, for any sizes: how many of ``sample`` rows are among ``good`` of ``good + bad``."""
    if good + bad < NUMPY_ROWS:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(sample, good)
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), low), high)
    spread = int(40 * (sample * (good / (good + bad)) * (bad / (good + bad))) ** 0.5) + 40
    up = np.arange(mode, min(high, mode + spread), dtype=np.float64)
    down = np.arange(mode, max(low, mode - spread), -1, dtype=np.float64)
    # probabilities relative to the mode's, from the ratio of neighbours
    rise = np.cumprod((good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1)))
    fall = np.cumprod(down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1)))
    weights = np.concatenate([fall[::-1], [1.0], rise])
    at = np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right")
    return mode - len(fall) + min(int(at), len(weights) - 1)


def communication_matrix(parts: Sequence[int], blocks: Sequence[int], seed: int) -> np.ndarray:
    """Rows that each part sends to each block; row sums are ``parts``, column sums ``blocks``."""
    rng = np.random.default_rng(seed)
    room = np.array(blocks, dtype=np.int64)
    matrix = np.zeros((len(parts), len(blocks)), dtype=np.int64)
    for part, rows in enumerate(parts):
        if room.sum() < NUMPY_ROWS:
            matrix[part] = rng.multivariate_hypergeometric(room, rows, method="marginals")
        else:
            left, rest = rows, int(room.sum())
            for block, free in enumerate(room.tolist()):
                rest -= free
                matrix[part, block] = draw(rng, free, rest, left) if left else 0
                left -= int(matrix[part, block])
        room -= matrix[part]
    return matrix


def block_sizes(rows: int, shards: int, block_rows: int = BLOCK_ROWS) -> list[tuple[int, int, int]]:
    """(shard, first slot, size) of each block. Shard sizes differ by one row at most."""
    per_shard = max(1, min(-(-rows // (shards * block_rows)), MAX_BLOCKS // shards))
    out = []
    for shard in range(shards):
        size = rows // shards + (shard < rows % shards)
        cuts = [size * i // per_shard for i in range(per_shard + 1)]
        out += [(shard, a, b - a) for a, b in zip(cuts, cuts[1:])]
    return out


def shuffle_to_shards(df: DataFrame, shards: int = 16, seed: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``df`` with ``shard`` (from 0) and ``slot`` (from 0, gapless within its shard), uniformly shuffled.

    Row counts of shards differ by one at most. Rows are permuted by their place in the input, not by what they hold, so
    equal rows are spread like any others; nulls and texts of any length are carried along. Select narrow columns first,
    since all columns are exchanged twice. The same input files and seed give the same result. Columns named ``shard`` or
    ``slot`` are refused. An empty table gives no rows; with fewer rows than shards, the last shards stay empty.
    """
    if clash := {c.lower() for c in df.columns} & {"shard", "slot"}:
        raise ValueError(f"input columns have names of the result: {sorted(clash)}")
    if not 1 <= shards <= MAX_BLOCKS:
        raise ValueError(f"shards must be from 1 to {MAX_BLOCKS}")
    part, mix, block = (free_name(df.columns, c) for c in ("_part", "_mix", "_block"))
    rows = stored(
        # stored, so that the partitions that are counted are those dealt out, and a row keeps its number
        df.withColumn(part, F.pmod(F.spark_partition_id(), F.lit(MAX_PARTS))).withColumn(
            mix, F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
        ),
        "shards",
    )
    counts = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}
    order = sorted(counts)
    blocks = block_sizes(sum(counts.values()), shards, block_rows)
    matrix = communication_matrix([counts[p] for p in order], [b[2] for b in blocks], seed)
    shared = df.sparkSession.sparkContext.broadcast(({p: i for i, p in enumerate(order)}, matrix, blocks))

    def permuted(values: pa.ChunkedArray, salt: int) -> np.ndarray:
        mixed = values.to_numpy().astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (mixed ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.argsort(mixed ^ (mixed >> np.uint64(32)), kind="stable")

    def deal(group: pa.Table) -> pa.Table:
        index, cells, _ = shared.value
        counts_here = cells[index[group.column(part)[0].as_py()]]
        to = np.empty(group.num_rows, dtype=np.int32)
        to[permuted(group.column(mix), 1)] = np.repeat(np.arange(len(counts_here), dtype=np.int32), counts_here)
        return group.drop_columns([part]).append_column(block, pa.array(to))

    def settle(group: pa.Table) -> pa.Table:
        shard, first, _ = shared.value[2][group.column(block)[0].as_py()]
        slot = np.empty(group.num_rows, dtype=np.int64)
        slot[permuted(group.column(mix), 2)] = np.arange(first, first + group.num_rows)
        out = group.drop_columns([mix, block]).append_column("shard", pa.array(np.full(group.num_rows, shard, np.int32)))
        return out.append_column("slot", pa.array(slot))

    fields = list(df.schema.fields)
    dealt_schema = T.StructType([*fields, T.StructField(mix, T.LongType()), T.StructField(block, T.IntegerType())])
    final_schema = T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    dealt = in_python(rows).groupBy(part).applyInArrow(deal, dealt_schema)
    return dealt.groupBy(block).applyInArrow(settle, final_schema)


def digest_columns(id_column: str, text_column: str) -> list[Column]:
    """Identifier, size and checksum of a document: UTF-8 bytes of the text plus 1, and CRC-32 (a null text is empty)."""
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    return [F.col(id_column).alias("doc_id"), (F.length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")]


def write_shards(df: DataFrame, path: str, shards: int = 16, seed: int = 1) -> None:
    """Write the shuffled rows as Parquet, one folder per shard. Files hold consecutive slots in order, and a shard may
    have several: they are cut by ranges of slots, so that no shard is written by one task."""
    placed = shuffle_to_shards(df, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
