"""Near duplicates by Jaccard similarity of word n-grams, as a blocked sparse matrix product (operator 5).

Documents are the rows of an incidence matrix and their shingles (distinct runs of five words) its columns. Two
documents link when their shingles overlap enough; the product of the matrix with its transpose holds the overlaps. It
is worked out in blocks of columns, and only where it can reach the threshold:

* Documents with equal sets are one row (a class), named by its least identifier.
* Shingles are put in one order for all documents, those first that few documents should share: by counts over the
  whole corpus, of shingles (to send frequent passages to the end) and of their words. A row keeps its first columns
  only, as many as a linked row must share one of (prefix filter).
* A block of columns is sorted in numpy, and gives the rows that meet in a column. A pair is discarded where the sizes,
  or the columns that are left after the meeting, cannot make the overlap that the sizes ask for.
* What is left is held against a second bound, from a bit table of each row that is a thirtieth of its set: bits that
  differ count columns that only one of the two has.
* For the pairs that pass, overlaps are accumulated: a tile of rows is multiplied with itself one block of columns at a
  time, and a pair goes as soon as its overlap and what is left of its rows cannot make what the sizes ask for.

A column with few rows gives all their pairs. In larger ones, each row is first paired with a few others, and the links
found are merged to components. Then rows that meet but are still in different components are compared in the join
itself, which gives only pairs that pass both bounds, so copies never make all pairs of a large group. The bound of the
join tells little of texts with 14,000 shingles and more: where very many such texts share a rare passage, their pairs are
put out. Columns with more rows than a task should hold do not enter a block: their rows are paired with centres found
by aggregation. No component is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.llm.common import in_python, shuffle_partitions, stored
from bucketscope.llm.components import components, join_groups

WORDS = 5
#: Links need 100 x overlap >= PERCENT x union.
PERCENT = 75
#: Rows of a column up to which all its pairs are made at once.
FEW_ROWS = 8
#: How many others per larger column each row is compared with, before all that is left is.
STAR_ROUNDS = 3
#: Least and most 64-bit words of the coarse parity bits, which a join can compare; between, at least a bit a shingle.
COARSE_WORDS = 16
MOST_COARSE_WORDS = 128
#: Counters of shingles and of words; part of the order of shingles, which may be any.
SHINGLE_COUNTERS = 1 << 20
WORD_COUNTERS = 1 << 18
COUNTER_BLOCK = 1 << 12
#: Types of packed counts.
COUNT_KINDS = ("<u1", "<u2", "<u4", "<i8")
#: Tasks whose counters are summed in one group.
SUMMED_TASKS = 256
#: Entries of a block of columns.
BLOCK_ENTRIES = 1 << 20
#: Rows from which a column is not sorted in one task.
COLUMN_ROWS = 1 << 17
#: Entries of the rows whose product is worked out at once, and the blocks of columns it is accumulated over.
PRODUCT_ENTRIES = 1 << 20
PRODUCT_BLOCKS = 8
#: Distinct words that a Python worker remembers, none of more than LONG_WORD bytes.
CACHED = 500_000
LONG_WORD = 64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHED:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    """One for all tasks of a Python worker."""
    return _WordHashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text, lower-cased (A-Z only)."""
    words = (text or b"").lower().split()
    return np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash per run of five words, or one of all words where they are fewer."""
    size = min(len(words), WORDS)
    if not size:
        return np.zeros(0, np.uint64)
    count = len(words) - size + 1
    out = np.full(count, size, np.uint64)
    for i in range(size):
        out = _mixed((out + words[i : i + count]) * np.uint64(0x9E3779B97F4A7C15))
    return out


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles of a text, in ascending order of their hashes."""
    return np.unique(shingle_hashes(word_hashes(text)))


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold them."""
    kind = next(k for k in COUNT_KINDS if counts.max() <= np.iinfo(k).max)
    return counts.astype(kind).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    kind = next(k for k in COUNT_KINDS if np.dtype(k).itemsize == len(packed) // COUNTER_BLOCK)
    return np.frombuffer(packed, kind).astype(np.int64)


def counted(rows: DataFrame, size: int, counters: Callable[[bytes | None], list[np.ndarray]]) -> np.ndarray:
    """How often each of ``size`` counters is named by the values of the one column of ``rows``.

    Tasks add up their values. Their counters are summed block by block, first those of a few hundred tasks, then these
    sums, so that no group grows with the number of tasks as such; what is left is of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        pending: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            for value in batch.column(0):
                pending += counters(value.as_py())
                waiting += sum(map(len, pending[-2:]))
                if waiting > 1 << 22:
                    total += np.bincount(np.concatenate(pending), minlength=size)
                    pending, waiting = [], 0
        if pending:
            total += np.bincount(np.concatenate(pending), minlength=size)
        blocks = total.reshape(-1, COUNTER_BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        part = np.full(len(used), TaskContext.get().partitionId() // SUMMED_TASKS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(part, pa.int32()), pa.array([_packed(blocks[i]) for i in used], pa.binary())],
            ["block", "part", "counts"],
        )

    def add_up(group: pa.Table) -> pa.Table:
        total = np.zeros(COUNTER_BLOCK, np.int64)
        for counts in group.column("counts"):
            total += _unpacked(counts.as_py())
        return group.slice(0, 1).select(["block", "part"]).append_column("counts", pa.array([_packed(total)], pa.binary()))

    schema = "block int, part int, counts binary"
    parts = in_python(rows).mapInArrow(run, schema).groupBy("block", "part").applyInArrow(add_up, schema)
    out = np.zeros((size // COUNTER_BLOCK, COUNTER_BLOCK), np.int64)
    for block, _, counts in parts.groupBy("block").applyInArrow(add_up, schema).collect():
        out[block] = _unpacked(bytes(counts))
    return out.ravel()


def corpus_counts(texts: DataFrame) -> np.ndarray:
    """Counters of shingles, then of words, over all texts (one binary column)."""

    def counters(text: bytes | None) -> list[np.ndarray]:
        words = word_hashes(text)
        shingles = np.unique(shingle_hashes(words))
        return [
            (shingles & np.uint64(SHINGLE_COUNTERS - 1)).astype(np.int64),
            (words & np.uint64(WORD_COUNTERS - 1)).astype(np.int64) + SHINGLE_COUNTERS,
        ]

    return counted(texts, SHINGLE_COUNTERS + WORD_COUNTERS, counters)


def column_counts(prefixes: DataFrame) -> np.ndarray:
    """Counters of columns over all prefixes (one binary column); each is at least the rows of any of its columns.
    Prefixes of equal sets count each."""
    return counted(prefixes, SHINGLE_COUNTERS, lambda prefix: [column_counter(np.frombuffer(prefix or b"", np.uint64))])


def column_counter(columns: np.ndarray) -> np.ndarray:
    return (columns & np.uint64(SHINGLE_COUNTERS - 1)).astype(np.int64)


def order_levels(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By counter: how far a shingle is above what chance puts into its counter, and how frequent a word is (log2)."""
    shingles, words = counts[:SHINGLE_COUNTERS], counts[SHINGLE_COUNTERS:]
    usual = 2 * shingles.mean() + 8
    heavy = np.maximum(0, np.floor(np.log2(np.maximum(shingles, 1) / usual) + 1)).astype(np.uint64)
    common = np.round(np.log2(words + 1.0) * 32).astype(np.uint64)
    return heavy, common


def parity_bits(shingles: np.ndarray) -> bytes:
    """A bit per counter, whether an odd number of the shingles falls into it; at least two counters a shingle."""
    size = 1 << max(6, (2 * len(shingles)).bit_length())
    return np.packbits(np.bincount((_mixed(shingles) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def coarse_bits(bits: bytes) -> list[int]:
    """The parities, folded where they are more than the least number of words: once, then down to the largest number."""
    own = np.frombuffer(bits, np.int64)
    size = min(MOST_COARSE_WORDS, max(COARSE_WORDS, len(own) // 2))
    if len(own) > size:
        own = np.bitwise_xor.reduce(own.reshape(-1, size), axis=0)
    return own.tolist()


def _folded(coarse: Column) -> Column:
    """Coarse bits of half as many words."""
    half = F.floor(F.size(coarse) / 2).cast("int")
    return F.zip_with(F.slice(coarse, F.lit(1), half), F.slice(coarse, half + 1, half), lambda a, b: a.bitwiseXOR(b))


def most_overlap(n: int, bits: bytes, other_n: int, other_bits: bytes) -> int:
    """A bound of the overlap: counters of different parity hold a shingle each that only one of the two sets has."""
    one, two = (np.frombuffer(b, np.uint8) for b in (bits, other_bits))
    size = min(len(one), len(two))
    # the parities of fewer counters are those of more, taken together
    one, two = (np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in (one, two))
    return (n + other_n - int(np.bitwise_count(one ^ two).sum())) // 2


def ordered_prefix(text: bytes | None, levels: tuple[np.ndarray, np.ndarray]) -> tuple[int, bytes, np.ndarray, bytes]:
    """Size and fingerprint of a text's set, the shingles of its prefix in order, and the set's parity bits."""
    words = word_hashes(text)
    hashes = shingle_hashes(words)
    if not len(hashes):
        return 0, b"", hashes, b""
    found, first = np.unique(hashes, return_index=True)
    heavy, common = levels
    each = common[(words & np.uint64(WORD_COUNTERS - 1)).astype(np.int64)]
    size = min(len(words), WORDS)
    sums = np.zeros(len(hashes), np.uint64)
    for i in range(size):
        sums += each[i : i + len(hashes)]
    level = heavy[(found & np.uint64(SHINGLE_COUNTERS - 1)).astype(np.int64)]
    # level, then rarity of the words, then the hash
    rank = (level << np.uint64(58)) | (sums[first] << np.uint64(44)) | (found >> np.uint64(20))
    n = len(found)
    length = n - -(-PERCENT * n // 100) + 1
    order = np.argsort(rank, kind="stable")[:length]
    return n, xxhash.xxh3_128_digest(found.tobytes()), found[order], parity_bits(found)


def incidence(docs: DataFrame, levels: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, n, print, prefix, bits, coarse`` per document."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [ordered_prefix(t.as_py(), shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([m[0] for m in made], pa.int64()),
                    pa.array([m[1] for m in made], pa.binary()), pa.array([m[2].tobytes() for m in made], pa.binary()),
                    pa.array([m[3] for m in made], pa.binary()), pa.array([coarse_bits(m[3]) for m in made], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "print", "prefix", "bits", "coarse"],
            )

    return in_python(docs).mapInArrow(run, "doc_id long, n long, print binary, prefix binary, bits binary, coarse array<long>")


def large_counters(counts: np.ndarray, column_rows: int = COLUMN_ROWS) -> np.ndarray:
    """Which counters may hold a column of more than ``column_rows`` rows; a bound that also grows with their mean."""
    return counts > column_rows + 2 * counts.mean()


def _coded(columns: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each column, and its number within and across blocks."""
    block = (columns >> np.uint64(32)) % np.uint64(blocks)
    return block.astype(np.int32), (columns & np.uint64(0xFFFFFFFF)).astype(np.int64) | (block << np.uint64(32)).astype(np.int64)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The columns of the rows ``node, n, prefix`` of a batch, with node, n and place of each."""
    own = [np.frombuffer(p.as_py(), np.uint64) for p in batch.column(2)]
    lengths = np.array([len(p) for p in own], np.int64)
    columns = np.concatenate([*own, np.zeros(0, np.uint64)])
    node = np.repeat(batch.column(0).to_numpy(), lengths)
    n = np.repeat(batch.column(1).to_numpy(), lengths)
    return columns, node, n, np.arange(len(columns)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def large_columns(rows: DataFrame, blocks: int, large: Broadcast) -> DataFrame:
    """As ``meeting_rows``, for the columns of large counters, which no task holds whole.

    Each row is paired with the centre of its column, size class and salt, found by an aggregation that tasks begin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, node, n, place = _entries(batch)
            at = large.value[column_counter(columns)]
            made = [_coded(columns[at], blocks)[1], node[at], n[at], place[at]]
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], ["column", "node", "n", "place"])

    entries = stored(in_python(rows).mapInArrow(run, "column long, node long, n long, place long"), "large-columns")
    salted = entries.select("*", F.explode(F.sequence(F.lit(0), F.lit(STAR_ROUNDS - 1))).alias("salt"))
    like = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)) + F.col("salt") / STAR_ROUNDS).alias("like")
    salted = salted.select("*", like)
    keys = ["column", "salt", "like"]
    drawn = F.struct(F.xxhash64("salt", "node").alias("drawn"), "node", "n", "place")
    centres = stored(salted.groupBy(*keys).agg(F.min(drawn).alias("centre"), F.count(F.lit(1)).alias("members")), "centres")
    paired = join_groups(salted, centres, keys, "members", STAR_ROUNDS * max(1, entries.count()))
    able = _possible(F.col("n"), F.col("place"), F.col("centre.n"), F.col("centre.place"))
    stars = paired.where(able & (F.col("node") != F.col("centre.node"))).select(
        F.least("node", "centre.node").alias("node"), F.greatest("node", "centre.node").alias("other")
    )
    none = F.lit(None).cast("long")
    pairs = stars.distinct().select(none.alias("column"), "node", "other", none.alias("n"), none.alias("place"))
    return pairs.unionByName(entries.withColumn("other", none))


def meeting_rows(rows: DataFrame, blocks: int, large: np.ndarray) -> DataFrame:
    """Pairs ``node, other``, and ``column, node, n, place`` of each row of the columns that have not given all their
    pairs, from ``node, n, prefix``; what does not apply is null.

    Each batch of rows is cut into blocks of columns, packed; a block is sorted in numpy by one task. Columns of ``large``
    counters are left to ``large_columns``.
    """
    several = bool(large.any())
    rows = stored(rows, "prefixes") if several else rows
    shared = rows.sparkSession.sparkContext.broadcast(large)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, node, n, place = _entries(batch)
            small = ~shared.value[column_counter(columns)]
            columns, node, n, place = columns[small], node[small], n[small], place[small]
            if not len(columns):
                continue
            block = _coded(columns, blocks)[0]
            order = np.argsort(block, kind="stable")
            at = np.flatnonzero(np.diff(block[order], prepend=-1))
            parts = np.split(order, at[1:])
            packed = [
                [values[p].astype(kind).tobytes() for p in parts]
                for values, kind in ((columns, "<u4"), (node, "<i8"), (n, "<u4"), (place, "<u4"))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[order][at]), *[pa.array(p, pa.binary()) for p in packed]], ["block", "columns", "nodes", "n", "places"]
            )

    def meet(group: pa.Table) -> pa.Table:
        unpack = lambda name, kind: np.concatenate([np.frombuffer(v.as_py(), kind) for v in group.column(name)])
        columns, nodes, n, places = (unpack(*x) for x in (("columns", "<u4"), ("nodes", "<i8"), ("n", "<u4"), ("places", "<u4")))
        order = np.argsort(columns, kind="stable")
        columns, nodes, n, places = columns[order], nodes[order], n[order].astype(np.int64), places[order].astype(np.int64)
        starts = np.flatnonzero(np.append(True, columns[1:] != columns[:-1]))
        rows = np.diff(np.append(starts, len(columns)))
        rows = np.repeat(rows, rows)
        pairs = np.zeros((0, 2), np.int64)
        for apart in range(1, FEW_ROWS):
            at = np.flatnonzero((columns[apart:] == columns[:-apart]) & (rows[apart:] <= FEW_ROWS))
            other = at + apart
            able = possible(n[at], places[at], n[other], places[other]) & (nodes[at] != nodes[other])
            new = np.sort(np.stack([nodes[at[able]], nodes[other[able]]], axis=1), axis=1)
            pairs = np.unique(np.concatenate([pairs, new]), axis=0)
        many = rows > FEW_ROWS
        stars = [star_pairs(columns[many], nodes[many], n[many], places[many], salt) for salt in range(STAR_ROUNDS)]
        pairs = np.unique(np.concatenate([pairs, *stars]), axis=0)
        block = np.int64(group.column("block")[0].as_py())
        none = np.full(len(pairs), None)
        return pa.table({
            "column": pa.array([*none, *(columns[many].astype(np.int64) | (block << np.int64(32)))], pa.int64()),
            "node": np.concatenate([pairs[:, 0], nodes[many]]),
            "other": pa.array([*pairs[:, 1].tolist(), *[None] * int(many.sum())], pa.int64()),
            "n": pa.array([*none, *n[many]], pa.int64()), "place": pa.array([*none, *places[many]], pa.int64()),
        })

    packed = in_python(rows).mapInArrow(cut, "block int, columns binary, nodes binary, n binary, places binary")
    met = packed.groupBy("block").applyInArrow(meet, "column long, node long, other long, n long, place long")
    return met.unionByName(large_columns(rows, blocks, shared)) if several else met


def star_pairs(columns: np.ndarray, nodes: np.ndarray, n: np.ndarray, places: np.ndarray, salt: int) -> np.ndarray:
    """Each row of a block with one of those it meets in a column, among rows of like size; which one depends on
    ``salt``, and is the same in other columns with these rows."""
    like = np.floor(np.log(n) / np.log(100 / PERCENT) + salt / STAR_ROUNDS).astype(np.int64)
    order = np.lexsort((nodes, _mixed(nodes.astype(np.uint64) + np.uint64(salt << 56)), like, columns))
    columns, nodes, n, places, like = columns[order], nodes[order], n[order], places[order], like[order]
    first = np.append(True, (columns[1:] != columns[:-1]) | (like[1:] != like[:-1]))[: len(columns)]
    centre = np.maximum.accumulate(np.where(first, np.arange(len(columns)), 0))
    able = possible(n, places, n[centre], places[centre]) & (nodes != nodes[centre])
    return np.unique(np.sort(np.stack([nodes[able], nodes[centre[able]]], axis=1), axis=1), axis=0)


def possible(n, place, other_n, other_place):
    """Whether two rows whose first common column is at these places can overlap enough; for arrays."""
    most = np.minimum(n - place, other_n - other_place)
    sizes = np.minimum(n, other_n) * 100 >= np.maximum(n, other_n) * PERCENT
    return sizes & (most * (100 + PERCENT) >= (n + other_n) * PERCENT)


def _possible(n: Column, place: Column, other_n: Column, other_place: Column) -> Column:
    """As ``possible``, for columns of a table."""
    most = F.least(n - place, other_n - other_place)
    sizes = F.least(n, other_n) * 100 >= F.greatest(n, other_n) * PERCENT
    return sizes & (most * (100 + PERCENT) >= (n + other_n) * PERCENT)


def _cross_pairs(met: DataFrame, rows: DataFrame) -> DataFrame:
    """All pairs of rows that meet in a column, are in different components and pass the bounds."""
    several = met.groupBy("column").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    several = several.where("least <> most").select("column")
    left = stored(met.join(several.hint("merge"), "column", "left_semi"), "apart")
    # a row of a set's coarse bits for each of its columns: 1 KB at most
    bits = rows.select(F.col("doc_id").alias("node"), "n", "coarse").hint("merge")
    with_bits = stored(left.join(bits, ["node", "n"]).distinct(), "apart-bits")
    with_bits = with_bits.withColumn("folded", _folded(F.col("coarse")))
    x, y = with_bits.alias("x"), with_bits.alias("y")
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    able = _possible(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"))
    sizes = F.col("x.n") + F.col("y.n")
    # of rows of like size one has twice the words of the other at most
    one = F.when(F.size("x.coarse") > F.size("y.coarse"), F.col("x.folded")).otherwise(F.col("x.coarse"))
    two = F.when(F.size("y.coarse") > F.size("x.coarse"), F.col("y.folded")).otherwise(F.col("y.coarse"))
    words = F.zip_with(one, two, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differ = F.aggregate(words, F.lit(0), lambda t, c: t + F.coalesce(c, F.lit(0)))
    bound = (F.size(one) != F.size(two)) | (F.floor((sizes - differ) / 2) * (100 + PERCENT) >= sizes * PERCENT)
    pairs = x.join(y.hint("merge"), (F.col("x.column") == F.col("y.column")) & apart & able & bound)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def overlapping(left: np.ndarray, right: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Which pairs of rows (by their places in ``rows``, sets of shingles in ascending order) overlap enough.

    The product of the rows with each other is accumulated block of columns by block of columns, for these pairs only.
    After each block, pairs whose overlap so far cannot reach what their sizes ask for, even if all that is left of the
    smaller rest were common, are discarded.
    """
    sizes = np.array([len(r) for r in rows], np.int64)
    need = -(-PERCENT * (sizes[left] + sizes[right]) // (100 + PERCENT))
    overlap = np.zeros(len(left), np.int64)
    edges = np.arange(1, PRODUCT_BLOCKS, dtype=np.uint64) << np.uint64(64 - (PRODUCT_BLOCKS - 1).bit_length())
    cuts = np.zeros((len(rows), PRODUCT_BLOCKS + 1), np.int64)
    cuts[:, 1:-1] = [np.searchsorted(r, edges) for r in rows]
    cuts[:, -1] = sizes
    open_ = np.flatnonzero(np.minimum(sizes[left], sizes[right]) >= need)
    for block in range(PRODUCT_BLOCKS):
        if not len(open_):
            break
        used = np.unique(np.concatenate([left[open_], right[open_]]))
        lengths = cuts[used, block + 1] - cuts[used, block]
        entries = np.concatenate([rows[i][cuts[i, block] : cuts[i, block + 1]] for i in used])
        columns = np.unique(entries, return_inverse=True)[1].astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        met = []
        for side in (left, right):
            row = np.searchsorted(used, side[open_])
            pair = np.repeat(np.arange(len(open_)), lengths[row])
            inside = np.arange(len(pair)) - np.repeat(np.cumsum(lengths[row]) - lengths[row], lengths[row])
            met.append(pair * (len(columns) + 1) + columns[np.repeat(starts[row], lengths[row]) + inside])
        # a pair has a column twice where both rows have it
        both = np.sort(np.concatenate(met))
        common = both[1:][both[1:] == both[:-1]] // (len(columns) + 1)
        overlap[open_] += np.bincount(common, minlength=len(open_))
        rest = np.minimum(sizes[left] - cuts[left, block + 1], sizes[right] - cuts[right, block + 1])
        open_ = open_[(overlap + rest >= need)[open_]]
    keep = np.zeros(len(left), bool)
    keep[open_] = True
    return keep


def _tiles(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """The pairs of a batch, a tile of rows at a time; equal sets are one row."""
    left, right, rows, places, entries = [], [], [], {}, 0
    for pair in zip(batch.column(2), batch.column(3)):
        for side, values in zip((left, right), pair):
            packed = values.as_py()
            at = places.setdefault(packed, len(rows))
            if at == len(rows):
                rows.append(np.frombuffer(packed, np.uint64))
            side.append(at)
            # a pair costs its entries also where its rows are there already
            entries += len(rows[at])
        if entries > PRODUCT_ENTRIES:
            yield left, right, rows
            left, right, rows, places, entries = [], [], [], {}, 0
    if left:
        yield left, right, rows


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [overlapping(np.array(left), np.array(right), rows) for left, right, rows in _tiles(batch)]
            if keep:
                yield batch.select([0, 1]).filter(pa.array(np.concatenate(keep), pa.bool_()))

    own = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.hint("merge").join(own.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "x", "y")
    return in_python(joined).mapInArrow(run, "a long, b long")


def _filter_bits(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """A bit table that has every node, and others by chance: 8 bits a node, 32 MB at most."""
    bits = 1 << min(28, max(15, (8 * nodes.count()).bit_length()))
    at = F.pmod(F.xxhash64(F.lit("bits"), "node"), F.lit(bits))
    rows = nodes.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    found = rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    table = np.zeros((bits // (1 << 15) + 1, 1 << 12), np.uint8)
    for bucket, part in found:
        table[bucket] = np.frombuffer(bytes(part), np.uint8)
    return bits, table.reshape(-1)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` for every node, and for some others that the filter lets through; no text is shuffled."""
    bits, table = _filter_bits(nodes)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            wanted = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7)) & 1 == 1))
            made = pa.array([shingle_set(t.as_py()).tobytes() for t in wanted.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([wanted.column(0), made], ["node", "shingles"])

    # the bucket number counts from 1
    place = F.pmod(F.xxhash64(F.lit("bits"), "doc_id"), F.lit(bits))
    bit = F.bitmap_bucket_number(place) * F.lit(1 << 15) + F.bitmap_bit_position(place)
    rows = docs.where("doc_id is not null").select("doc_id", "text", bit.alias("bit"))
    return in_python(rows).mapInArrow(run, "node long, shingles binary")


def _bounded(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs whose parity bits leave room for the overlap that is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, bits, m, other in zip(*[batch.column(i).to_pylist() for i in range(2, 6)]):
                keep.append(most_overlap(n, bits, m, other) * (100 + PERCENT) >= PERCENT * (n + m))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    own = rows.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    other = rows.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    joined = pairs.hint("merge").join(own.hint("merge"), "a").join(other.hint("merge"), "b")
    return in_python(joined).select("a", "b", "na", "xa", "nb", "xb").mapInArrow(run, "a long, b long")


def _checked(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among candidate pairs."""
    pairs = stored(_bounded(stored(pairs.distinct(), "candidates"), rows).distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return stored(_verified(pairs, stored(_sets(docs, nodes), "sets")).distinct(), "links")


def _labels(docs: DataFrame, rows: DataFrame, met: DataFrame) -> DataFrame | None:
    """``node, component`` of all rows that link; None where none does."""
    pairs = met.where("column is null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    many = met.where("column is not null").select("column", "node", "n", "place")
    links = _checked(pairs, rows, docs)
    if links.isEmpty():
        labelled = many.withColumn("component", F.col("node"))
    else:
        labels = stored(components(links), "labels")
        joined = many.join(labels.hint("merge"), "node", "left")
        labelled = joined.withColumn("component", F.coalesce("component", "node"))
    more = _checked(_cross_pairs(stored(labelled, "labelled"), rows), rows, docs)
    links = links.unionByName(more)
    return None if links.isEmpty() else stored(components(links), "labels")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest identifier that can be reached by links. Identifiers are whole numbers. A null,
    empty or blank text has no shingles and links with nothing; a text of fewer than five words is one shingle. Rows
    repeated whole are of one class. Rows with a null identifier link with nothing (their component is null). A
    repeated identifier with different texts is in the component of each row's own text. Other columns are not read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    levels = order_levels(corpus_counts(texts.select("text")))
    rows = stored(incidence(texts, levels), "incidence")
    linked = rows.where("n > 0 and doc_id is not null")
    classes = linked.groupBy("print", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("members"))
    classes = stored(classes, "classes")
    one_each = linked.groupBy("print", "n").agg(F.min("doc_id").alias("node"), F.min_by("prefix", "doc_id").alias("prefix"))
    entries = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).first()[0] or 0
    blocks = max(shuffle_partitions(spark), -(-int(entries) // BLOCK_ENTRIES))
    large = large_counters(column_counts(linked.select("prefix")))
    met = stored(meeting_rows(one_each.select("node", "n", "prefix"), blocks, large), "met")
    labels = _labels(texts, linked.select("doc_id", "n", "bits", "coarse"), met)
    if labels is None:
        named = classes.withColumn("component", F.col("node"))
    else:
        named = classes.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named.select("print", "n", "members", "component"), "named")
    total = rows.count()
    inside = join_groups(linked.select("doc_id", "n", "print"), named, ["print", "n"], "members", total)
    alone = rows.where("n = 0 or doc_id is null")
    return inside.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(
        alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that name their components, and those without an identifier, with their own columns."""
    found = near_duplicates(docs, id_column, text_column)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone.hint("merge"), docs[id_column].cast("long") == gone["gone"], "left_anti")
