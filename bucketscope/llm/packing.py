"""Best-fit packing with Martello-Toth dominance reduction (operator 7).

Documents become token pieces of at most ``capacity`` tokens. What the packing needs to know about them is how many
pieces there are of each length, a histogram of at most ``capacity`` entries. On it, sets of at most three lengths that
provably dominate every other filling of a sequence are fixed first; what remains is packed best-fit, longest first.
The result is a list of patterns with multiplicities, in which each piece finds its place by its rank among the pieces
of its length. Only the histogram and the patterns are on the driver.
"""

from __future__ import annotations

import bisect
import codecs
import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketscope.llm.common import in_python, running_total, stored

CAPACITY = 2048
END_ID = 0
#: Bytes that a task spends on remembering the ids of chunks, and what an entry takes beside its text and ids. Chunks of
#: more characters than LONG_CHUNK are not remembered.
CACHE_BYTES = 160 << 20
ENTRY_BYTES = 200
LONG_CHUNK = 64
#: Bytes of texts whose chunks are looked up together; a longer text is encoded by itself.
GROUP_BYTES = 8 << 20
WORDS_AT_ONCE = 1 << 16
#: Pieces of equal length are ranked in chunks of a uniform hash.
CHUNKS = 256

#: Where pre-tokenisation always splits: at a single space between two characters that are not blank.
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")

#: Marks that are never in one token with a letter or digit before them; an apostrophe may begin a word's ending.
_MARKS = ".,;:!?#%&*$|)(\"-_"
#: Letters of which a run is one word of the pre-tokenisation.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"

Pattern = tuple[tuple[int, int], ...]


class _Odd(Exception):
    """A chunk that starts or ends with a blank, so that the space before or after it is not a single one."""


# How a byte-level vocabulary writes a byte: as itself where it prints, the others as the characters from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_MARKS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}
_BYTE_TABLE = "".join(chr(_BYTE_MARKS.get(b, b)) for b in range(256))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _gathered(values: np.ndarray, counts: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Of runs of values, each ``counts`` long, those that ``index`` names, in a row."""
    each = counts[index]
    skipped = (np.cumsum(counts) - counts)[index] - (np.cumsum(each) - each)
    return values[np.arange(each.sum()) + np.repeat(skipped, each)]


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    A byte-level vocabulary splits a text into words before it merges, and never across a single space between two
    characters that are not blank: such a space begins the word after it. The texts are cut there. For a column of texts,
    each distinct chunk of a group is encoded once and the ids of the texts are gathered from those; where a text is encoded
    by itself, and for chunks that are no plain words, the ids of chunks are remembered.
    """

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # each becomes its one id where a text holds its string; such texts are encoded whole
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.model = self.tokenizer.model
        # the same merges, over many words at once, one a line
        self.lines = Tokenizer(self.model)
        self.lines.pre_tokenizer = CharDelimiterSplit("\n".translate(_BYTE_MARKS))
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.newline = self.ids("\n")
        self.first: dict[str, bytes] = _Chunks(self, "")
        self.later: dict[str, bytes] = _Chunks(self, " ")

    def ids(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word_ids(self, word: str) -> bytes:
        """Of a word that pre-tokenisation leaves whole: the merges alone."""
        return _packed([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_MARKS))])

    def words_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, each alone or after a space, and how many ids each has."""
        all_ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = words.slice(start, WORDS_AT_ONCE)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "\n")[0].as_buffer()
            written = codecs.charmap_decode(joined, "strict", _BYTE_TABLE)[0]
            ids = np.array(self.lines.encode_batch_fast([written], add_special_tokens=False)[0].ids, dtype="<u4")
            # a word ends where the tokens are as long as all words so far
            words_end = np.cumsum(pc.binary_length(some).to_numpy())
            tokens_end = np.cumsum(self.token_bytes[ids])
            ends = np.searchsorted(tokens_end, words_end) + 1
            if ends[-1] != len(ids) or not np.array_equal(tokens_end[ends - 1], words_end):
                raise ValueError("the vocabulary does not write every byte")
            all_ids.append(ids)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(all_ids), np.concatenate(counts)

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a column, a null as an empty one."""
        column = pc.fill_null(column, "")
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(column):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + GROUP_BYTES, side="right")))
            if ends[stop - 1] - before > GROUP_BYTES:
                yield self(column[start].as_py())
            else:
                yield from self._group(column.slice(start, stop - start).cast(pa.string()))
            start = stop

    def _group(self, texts: pa.Array) -> Iterator[bytes]:
        """Each distinct chunk of the texts is encoded once, words of letters all together; the ids of the texts are gathered
        from those of the chunks."""
        # a newline goes to the chunk after it, so that it does not join two words to a chunk of their own
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        starts -= starts[0]
        index = coded.indices.to_numpy().astype(np.int64)
        heads, which = np.unique(index[starts[:-1]], return_inverse=True)
        index[starts[:-1]] = len(coded.dictionary) + which
        chunks = pa.concat_arrays([coded.dictionary, coded.dictionary.take(pa.array(heads))])
        ids, counts, strange = self._chunks(chunks, np.arange(len(chunks)) >= len(coded.dictionary))
        strange = np.logical_or.reduceat(strange[index], starts[:-1])
        for token in self.added:
            strange |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        ends = np.cumsum(counts[index])[starts[1:] - 1]
        own = _gathered(ids, counts, index).tobytes()
        start = 0
        for at, (end, by_itself) in enumerate(zip((4 * ends).tolist(), strange.tolist())):
            yield self(texts[at].as_py()) if by_itself else own[start:end]
            start = end

    def _chunks(self, chunks: pa.Array, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks in a row, how many each has, and which hold blanks where they begin or end, and so have none.
        ``head`` says which begin a text. A newline that begins a chunk stands in the place of the space before it."""
        line = pc.starts_with(chunks, "\n")
        rest = pc.if_else(line, pc.utf8_slice_codeunits(chunks, 1), chunks)
        plain = pc.match_substring_regex(rest, f"^[{_LETTERS}]+[{re.escape(_MARKS)}]*\\z")
        line, plain = line.to_numpy(zero_copy_only=False), plain.to_numpy(zero_copy_only=False)
        alone = line | head
        given = rest.filter(pa.array(plain))
        before = pa.array(np.where(alone[plain], "", " "), pa.string())
        words = pc.binary_join_element_wise(before, pc.ascii_rtrim(given, _MARKS), "").dictionary_encode()
        marks = pc.replace_substring_regex(given, f"^[{_LETTERS}]+", "").dictionary_encode()
        others = np.flatnonzero(~plain)
        told = [self._other(chunk, alone[at]) for at, chunk in zip(others.tolist(), rest.take(pa.array(others)).to_pylist())]
        strange = np.zeros(len(chunks), dtype=bool)
        strange[others] = [ids is None for ids in told]
        # parts: no ids, a newline, other chunks, marks, words
        parts = [b"", self.newline, *[ids or b"" for ids in told], *[self.first[m] if m else b"" for m in marks.dictionary.to_pylist()]]
        ids, counts = self.words_ids(words.dictionary)
        ids = np.concatenate([np.frombuffer(b"".join(parts), dtype="<u4"), ids])
        counts = np.concatenate([[len(part) // 4 for part in parts], counts])
        of = np.zeros((len(chunks), 3), dtype=np.int64)
        of[:, 0] = line
        of[others, 1] = 2 + np.arange(len(others))
        of[plain, 1] = len(parts) + words.indices.to_numpy()
        of[plain, 2] = 2 + len(others) + marks.indices.to_numpy()
        of[strange] = 0
        return _gathered(ids, counts, of.ravel()), counts[of].sum(axis=1), strange

    def _other(self, chunk: str, alone: bool) -> bytes | None:
        try:
            return (self.first if alone else self.later)[chunk]
        except _Odd:
            return None

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.added):
            return self.ids(text)
        try:
            first, *later = text.split(" ")
            return b"".join([self.first[first], *map(self.later.__getitem__, later)])
        except _Odd:
            first, *later = _SINGLE_SPACE.split(text)
            return b"".join([self.first.whole(first), *map(self.later.whole, later)])


class _Chunks(dict):
    """Ids of chunks, each after the text ``before`` it. What half of the bytes held becomes the older part when they are full,
    and stays as far as it is asked for again."""

    def __init__(self, encoder: Encoder, before: str):
        self.encoder, self.before, self.odd, self.older, self.size = encoder, before, {}, {}, 0
        self.mark = before.translate(_BYTE_MARKS)

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            if chunk.isascii() and chunk.isalpha():
                found = _packed([t.id for t in self.encoder.model.tokenize(self.mark + chunk)])
            elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise _Odd
            else:
                found = self._parts(chunk)
        self._remember(self, chunk, found)
        return found

    def _remember(self, where: dict[str, bytes], chunk: str, ids: bytes) -> None:
        if len(chunk) > LONG_CHUNK:
            return
        self.size += ENTRY_BYTES + len(chunk) + len(ids)
        if self.size > CACHE_BYTES // 2:
            self.older = dict(self)
            self.clear()
            self.odd.clear()
            self.size = 0
        where[chunk] = ids

    def _parts(self, chunk: str) -> bytes:
        """Ids of a new chunk, from those of its parts where pre-tokenisation splits it for certain."""
        line, newline, rest = chunk.partition("\n")
        if newline and not line[-1].isspace() and not rest[0].isspace():
            return self[line] + self.encoder.newline + self.encoder.first[rest]
        word = chunk.rstrip(_MARKS)
        if word != chunk and word and word[-1].isalnum():
            return self[word] + self.encoder.first[chunk[len(word) :]]
        if chunk.isalpha() and max(chunk) < "\u0250":
            return self.encoder.word_ids(self.before + chunk)
        return self.encoder.ids(self.before + chunk)

    def whole(self, chunk: str) -> bytes:
        """Of a chunk that may hold any blanks."""
        found = self.get(chunk) or self.older.get(chunk) or self.odd.get(chunk)
        if found is None:
            found = self.encoder.ids(self.before + chunk)
            self._remember(self.odd, chunk, found)
        return found


@lru_cache(maxsize=2)
def _encoder(tokenizer_path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(tokenizer_path)


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``, and ``with_ids`` the ids as ``ids`` (binary).

    A document is its ids, then one end id. Only longer ones are cut, into pieces of ``capacity``; the first piece takes
    what is left over. A null or empty text is the end id alone.
    """
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for at, ids in enumerate(encode.texts(batch.column(1))):
                ids += end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = min(n, capacity) if start else (n % capacity or capacity) if n > capacity else n
                    own = ids[4 * start : 4 * (start + length)]
                    for to, value in zip(rows, (at, piece, start, length, zlib.crc32(own), own if with_ids else None)):
                        to.append(value)
                    start, piece = start + length, piece + 1
            taken = pa.array(rows[0], pa.int64())
            columns = [batch.column(0).take(taken), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:5]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(rows[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    given = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return in_python(given).mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


class Histogram:
    """Counts of lengths, with the look-ups that the packing asks for."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {length: n for length, n in counts.items() if n}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int = 1) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)

    def largest(self, most: int) -> int | None:
        at = bisect.bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else None

    def smallest(self, n: int) -> list[int]:
        """The ``n`` smallest items, as many as there are."""
        out: list[int] = []
        for length in self.lengths:
            out += [length] * min(self.counts[length], n - len(out))
            if len(out) == n:
                break
        return out

    def pairs(self, most: int) -> Iterator[tuple[int, int]]:
        """For each length a, (a, the longest c up to a that fits beside it)."""
        for a in self.lengths:
            if a > most:
                break
            c = self.largest(min(a, most - a))
            if c == a and self.counts[a] < 2:
                c = self.largest(a - 1)
            if c is not None:
                yield a, c


def _dominating(items: Histogram, item: int, capacity: int) -> list[int] | None:
    """Items beside ``item`` (already taken out) that dominate every other choice, or None where that is not proven.

    One filling dominates another if the other's items can be dealt out to the one's so that none is exceeded: then no
    packing needs the other.
    """
    room = capacity - item
    single = items.largest(room)
    if single is None:
        return []
    small = items.smallest(3)
    # an exact fit holds whatever else would fit; so does the longest item where no two fit
    if single == room or len(small) < 2 or small[0] + small[1] > room:
        return [single]
    if len(small) == 3 and sum(small) <= room:
        return None
    pairs = list(items.pairs(room))  # at most two fit
    if single >= max(a + c for a, c in pairs):
        return [single]
    beside = dict(pairs).get(single)
    if beside is None:
        return None
    # no feasible pair has a longer first item than the longest; this one's second must not be exceeded either
    return [single, beside] if beside >= max(c for _, c in pairs) else None


def reduced(items: Histogram, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix every dominating set that can be proven, until none is left; ``items`` keeps what is not fixed."""
    fixed: dict[Pattern, int] = {}
    again = True
    while again:
        again = False
        for item in reversed(list(items.lengths)):
            while items.counts.get(item):
                items.take(item)
                others = _dominating(items, item, capacity)
                if others is None:
                    items.counts[item] = items.counts.get(item, 0) + 1
                    if item not in items.lengths:
                        bisect.insort(items.lengths, item)
                    break
                for other in others:
                    items.take(other)
                # the proof holds again while the same items are left: taking items away only removes choices
                needed = Counter([item, *others])
                more = min(items.counts.get(length, 0) // n for length, n in needed.items())
                if more:
                    for length, n in needed.items():
                        items.take(length, n * more)
                pattern = _pattern([item, *others])
                fixed[pattern] = fixed.get(pattern, 0) + 1 + more
                again = True
    return list(fixed.items())


def _pattern(lengths: list[int]) -> Pattern:
    return tuple((length, lengths.count(length)) for length in sorted(set(lengths), reverse=True))


def best_fit(items: Histogram, capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first, each into the fullest open sequence that has room; equal sequences are handled together."""
    open_by_room: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if room not in open_by_room:
                open_by_room[room] = []
                bisect.insort(rooms, room)
            open_by_room[room].append((pattern, times))

    for length in reversed(items.lengths):
        left = items.counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(left, capacity // length)
                put(capacity - each * length, ((length, each),), left // each)
                left %= each
                continue
            room = rooms[at]
            pattern, times = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(at)
            # the fullest sequence takes items until it has no room for another
            each = min(left, room // length)
            used = min(times, left // each)
            put(room, pattern, times - used)
            put(room - each * length, (*pattern, (length, each)), used)
            left -= used * each
    return [(pattern, times) for group in open_by_room.values() for pattern, times in group]


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns ((length, items of it), ...) and how many sequences are filled by each."""
    items = Histogram(counts)
    return reduced(items, capacity) + best_fit(items, capacity)


def _places(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Per pattern and length: length, first rank, first sequence, items in a sequence, place of the first."""
    rows, ranks, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, ranks.get(length, 0), sequence, each, offset))
            ranks[length] = ranks.get(length, 0) + each * times
            offset += each * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with ``doc_id, piece, start, length, ids_crc32``) with ``sequence_id`` and ``offset``.

    Every piece gets a place, each sequence is filled from 0 without gaps, and none holds more than ``capacity``.
    Pieces equal in every column are interchangeable. An empty table gives no rows.
    """
    # at most ``capacity`` rows
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    places = _places(pack_lengths(counts, capacity))
    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    chunked = pieces.withColumn("chunk", F.pmod(mixed, F.lit(CHUNKS))).withColumn("mixed", mixed)
    order = [F.col(c) for c in ("mixed", "doc_id", "piece", "start", "ids_crc32")]
    ranked = running_total(chunked, ["length"], "chunk", order, F.lit(1), "rank").drop("chunk", "mixed")
    shared = pieces.sparkSession.sparkContext.broadcast(places)
    width = 1 << 44  # ranks stay below it

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] * width + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length * width + rank, side="right") - 1]
            nth = rank - row[:, 1]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return in_python(ranked).select(*columns).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **columns: str) -> DataFrame:
    """One row per token piece of every document, with its sequence and its place there; see ``token_pieces``, ``pack``.

    Nulls, empty and very long texts, and rows repeated whole each give their pieces; identifiers need not be unique.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, with_ids=False, **columns)
    return pack(stored(pieces, "pieces"), capacity)
