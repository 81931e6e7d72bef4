"""Importance resampling towards a target distribution with a head-tail vocabulary (operator 11).

Features of a text are its runs of one word, or of one and two words, hashed to buckets by the CRC-32 of their UTF-8
bytes. A bucket's gain is the log ratio of its share in the target texts to that in the documents; a document's weight
is the sum over its features, and the documents with the highest weight plus Gumbel noise are drawn.

Few words make up most of a corpus. The frequent ones (the head) are found in a pass over all documents and broadcast with
the exact CRC-32 state after each of them and the buckets of the frequent pairs, so a task looks up most features in an
Arrow hash table and hashes none of them. A word outside the head (the tail) gets its CRC-32 directly, once per chunk of
text; a pair of a head word and a tail word continues from the state of the first. Either way a feature has its exact
bucket: which words are in the head decides the speed, not any result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.llm.common import in_python, stored
from bucketscope.plans.skew import line_numbers

BUCKETS = 10_000
#: Entries of the broadcast head, and bytes of a word or pair in it: what bounds the broadcast (about 10 MB).
HEAD_WORDS = 1 << 15
HEAD_PAIRS = 1 << 16
HEAD_BYTES = 64
#: Distinct words and pairs that a task remembers while it looks for the head.
CANDIDATES = 1 << 18
#: Bytes of text that are handled together. A longer text is cut between two words.
CHUNK_BYTES = 8 << 20
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"

# words are runs of digits, a-z (A-Z made lower first) and everything beyond ASCII
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[ord("0") : ord("9") + 1] = True
_IN_WORD[ord("a") : ord("z") + 1] = True
_IN_WORD[ord("A") : ord("Z") + 1] = True
_IN_WORD[0x80:] = True


@dataclass
class Words:
    """The words of some rows, one after the other, and the row of each."""

    words: pa.Array
    row: np.ndarray

    def pairs(self) -> np.ndarray:
        """Places of words that are followed by another one of their row."""
        return np.flatnonzero(self.row[1:] == self.row[:-1])


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the rows that ``offsets`` cuts the UTF-8 bytes into."""
    inside = _IN_WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = inside[edges]
    begin = np.append(np.flatnonzero(start[inside]), np.count_nonzero(inside)).astype(np.int64)
    kept = _LOWER[data[inside]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(kept)])
    return Words(words, np.searchsorted(offsets, np.flatnonzero(start), side="right") - 1)


def _cut(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A long text in pieces of about ``size`` bytes, none of which ends inside a word."""
    at = 0
    while len(data) - at > size:
        # behind the last byte of no word, or before the next one if the piece is a single word
        gaps = np.flatnonzero(~_IN_WORD[data[at : at + size]])
        end = at + int(gaps[-1]) + 1 if len(gaps) else at + size
        while end < len(data) and not len(gaps):
            gaps = np.flatnonzero(~_IN_WORD[data[end : end + size]])
            end = end + int(gaps[0]) if len(gaps) else min(len(data), end + size)
        yield data[at:end]
        at = end
    yield data[at:]


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, Words, bool]]:
    """The words of a column of texts in chunks of bounded size: first row, words, and whether they continue that row."""
    if not len(texts):
        return
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(raw):
        last = int(np.searchsorted(ends, ends[row] + chunk_bytes, side="right")) - 1
        if last > row:
            yield row, split_words(data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]), False
            row = last
            continue
        for n, piece in enumerate(_cut(data[ends[row] : ends[row + 1]], chunk_bytes)):
            yield row, split_words(piece, np.array([0, len(piece)], np.int64)), n > 0
        row += 1


def joined_pairs(words: Words) -> pa.Array:
    at = words.pairs()
    return pc.binary_join_element_wise(words.words.take(pa.array(at)), words.words.take(pa.array(at + 1)), pa.scalar(b" ", pa.large_binary()))


@dataclass
class Head:
    """Frequent words with their buckets and the CRC-32 after each and a blank, and the buckets of frequent pairs."""

    buckets: int
    words: pa.Array
    word_buckets: np.ndarray
    states: np.ndarray
    pairs: np.ndarray
    pair_buckets: np.ndarray

    @staticmethod
    def of(words: list[bytes], pairs: list[bytes], buckets: int = BUCKETS) -> "Head":
        place = {w: i for i, w in enumerate(words)}
        keyed = {}
        for pair in pairs:
            a, b = pair.split(b" ")
            if a in place and b in place:
                keyed[place[a] * len(words) + place[b]] = zlib.crc32(pair) % buckets
        keys = np.array(sorted(keyed), np.int64)
        return Head(
            buckets,
            pa.array(words, pa.large_binary()),
            np.array([zlib.crc32(w) % buckets for w in words], np.int64),
            np.array([zlib.crc32(w + b" ") for w in words], np.int64),
            keys,
            np.array([keyed[k] for k in keys.tolist()], np.int64),
        )

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the head, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def of_words(self, words: pa.Array, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(place), np.int64)
        known = place >= 0
        out[known] = self.word_buckets[place[known]]
        tail = words.filter(pa.array(~known)).dictionary_encode()
        direct = np.array([zlib.crc32(w) % self.buckets for w in tail.dictionary.to_pylist()], np.int64)
        out[~known] = direct[tail.indices.to_numpy()] if len(direct) else 0
        return out

    def of_pairs(self, words: pa.Array, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Buckets of the pairs of words that begin at the places ``at``."""
        out = np.full(len(at), -1, np.int64)
        first, second = place[at].astype(np.int64), place[at + 1].astype(np.int64)
        if len(self.pairs):
            key = first * len(self.words) + second
            found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            known = (first >= 0) & (second >= 0) & (self.pairs[found] == key)
            out[known] = self.pair_buckets[found[known]]
        rest = np.flatnonzero(out < 0)
        if not len(rest):
            return out
        coded = words.dictionary_encode()
        spelt, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        distinct, again = np.unique(code[at[rest]] * len(spelt) + code[at[rest] + 1], return_inverse=True)
        a, b = distinct // len(spelt), distinct % len(spelt)
        state = self.places(coded.dictionary)
        direct = [
            zlib.crc32(spelt[y], int(self.states[state[x]])) if state[x] >= 0 else zlib.crc32(spelt[x] + b" " + spelt[y])
            for x, y in zip(a.tolist(), b.tolist())
        ]
        out[rest] = np.array(direct, np.int64)[again] % self.buckets
        return out

    def features(self, texts: pa.Array, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per chunk: the row and bucket of each feature, and the row of each word."""
        last = None
        for row, chunk, continues in chunks(texts):
            place = self.places(chunk.words)
            rows, found = [chunk.row + row], [self.of_words(chunk.words, place)]
            if max_words > 1:
                at = chunk.pairs()
                rows.append(chunk.row[at] + row)
                found.append(self.of_pairs(chunk.words, place, at))
                if continues and last is not None and len(chunk.words):
                    across = zlib.crc32(last + b" " + chunk.words[0].as_py()) % self.buckets
                    rows.append(np.array([row]))
                    found.append(np.array([across]))
                if len(chunk.words):
                    last = chunk.words[-1].as_py()
                elif not continues:
                    last = None
            yield np.concatenate(rows), np.concatenate(found), rows[0]


def _texts(docs: DataFrame, text_column: str) -> DataFrame:
    return in_python(docs.select(F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text")))


def find_head(docs: DataFrame, text_column: str = "text", max_words: int = 1, buckets: int = BUCKETS) -> Head:
    """The most frequent words and pairs of all documents.

    A task forgets rare ones when it has met very many, and none is longer than ``HEAD_BYTES``, so tasks, shuffle and
    broadcast are of bounded size. What is not found is hashed directly later, with the same result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for _, chunk, _ in chunks(batch.column(0)):
                for features in (chunk.words, joined_pairs(chunk)) if max_words > 1 else (chunk.words,):
                    short = features.filter(pc.less_equal(pc.binary_length(features), HEAD_BYTES))
                    values, counts = short.value_counts().flatten()
                    for feature, n in zip(values.to_pylist(), counts.to_pylist()):
                        seen[feature] += n
                if len(seen) > CANDIDATES:
                    seen = Counter(dict(seen.most_common(CANDIDATES // 2)))
        words = Counter({f: n for f, n in seen.items() if b" " not in f}).most_common(HEAD_WORDS)
        pairs = Counter({f: n for f, n in seen.items() if b" " in f}).most_common(HEAD_PAIRS)
        for kind, entries in ((1, words), (2, pairs)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in entries], pa.binary()), pa.array([kind] * len(entries), pa.int32()), pa.array([n for _, n in entries], pa.int64())],
                ["feature", "n_words", "n"],
            )

    found = _texts(docs, text_column).mapInArrow(count, "feature binary, n_words int, n long")
    totals = found.groupBy("n_words", "feature").agg(F.sum("n").alias("n"))

    def most_frequent(n_words: int, most: int) -> list[bytes]:
        rows = totals.where(F.col("n_words") == n_words).orderBy(F.desc("n"), "feature").limit(most).collect()
        return [bytes(r["feature"]) for r in rows]

    return Head.of(most_frequent(1, HEAD_WORDS), most_frequent(2, HEAD_PAIRS) if max_words > 1 else [], buckets)


def bucket_totals(texts: DataFrame, head: Head, text_column: str = "text", max_words: int = 1) -> np.ndarray:
    """How many features all texts have in each bucket, exactly."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(own.buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in own.features(batch.column(0), max_words):
                total += np.bincount(bucket, minlength=own.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    rows = _texts(texts, text_column).mapInArrow(add_up, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(head.buckets, np.int64)
    for bucket, n in rows.collect():
        out[bucket] = n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to that in the documents, with one added to each."""
    buckets, s, t = len(documents), documents.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (float(documents.sum()) + buckets) / ((s + 1) * (float(target.sum()) + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, head: Head, gain: np.ndarray, text_column: str = "text", max_words: int = 1) -> DataFrame:
    """All rows of ``docs`` with ``n_words``, ``n_features`` and ``weight`` in place of the text; no other column may
    have one of these names."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gain))
    others = docs.drop(text_column)
    rows = docs.select(*[F.col(f"`{c}`") for c in others.columns], F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("_text"))
    names = [*others.columns, "n_words", "n_features", "weight"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gained = shared.value
        for batch in batches:
            made = np.zeros((3, batch.num_rows), np.int64)
            for row, bucket, word in own.features(batch.columns[-1], max_words):
                made[0] += np.bincount(word, minlength=batch.num_rows)
                made[1] += np.bincount(row, minlength=batch.num_rows)
                # sums of whole numbers far below 2^53
                made[2] += np.bincount(row, gained[bucket], batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, made)], names=names)

    schema = others.schema
    for name in names[-3:]:
        schema = schema.add(name, "long")
    return in_python(rows).mapInArrow(score, schema)


def gumbel(identifier: Column, seed: str = SEED) -> Column:
    """Noise of a document in thousandths, from a hash of the seed and its identifier (a null one: empty)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_ranks(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_column: str = "text",
    max_words: int = 1,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every document; ``rank`` is null where it is not drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn: those of the
    highest score, ties to the smaller identifier, a null one last. Features are runs of one word, or up to two with
    ``max_words=2``. A null or empty text has no features and weight 0. Rows that repeat an identifier are documents of
    their own with the same noise. Texts of any length are read whole, in chunks. Other columns are not read, whatever
    their names. An empty table gives no rows; without target texts, all of a bucket's gain comes from the documents.
    """
    if max_words not in (1, 2):
        raise ValueError("features are runs of one or two words")
    if not 0 <= percent <= 100:
        raise ValueError("percent must be from 0 to 100")
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    wanted = target.select(F.col(target_column).alias("text"))
    head = find_head(narrow, max_words=max_words, buckets=buckets)
    gain = gains(bucket_totals(narrow, head, max_words=max_words), bucket_totals(wanted, head, max_words=max_words))
    scored = weigh(narrow, head, gain, max_words=max_words)
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    # stored, so that the places that spread equal rows over the ranges of the sort stay with them
    rows = stored(scored.select("*", score.alias("score"), F.monotonically_increasing_id().alias("_place")), "weights")
    eligible = F.col("n_words") >= least_words
    drawn = rows.where(eligible).count() * percent // 100
    order = [F.when(eligible, F.col("score")).desc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("_place")]
    placed = line_numbers(rows, order, "_rank")
    rank = F.when(F.col("_rank") <= drawn, F.col("_rank"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents drawn, with their own columns. Rows that share an identifier stay together if one of them is drawn,
    those with a null identifier among them."""
    ranks = importance_ranks(docs, target, id_column=id_column, text_column=text_column, **options)
    drawn = ranks.where("rank is not null").select("doc_id").distinct()
    return docs.join(drawn.hint("merge"), docs[id_column].eqNullSafe(drawn["doc_id"]), "left_semi")
