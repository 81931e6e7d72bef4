"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 6).

Letters are lower-cased and everything else is a word boundary. The n-grams of a batch of texts are hashed at once, as
array operations over its code points; an n-gram has a boundary at its ends only. Counts per language and bucket are
added up over all training documents; the matrix of log probabilities, languages by buckets, is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.llm.common import in_python

GRAM_SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: Languages that can be learned: what bounds the matrix, 8 bytes x BUCKETS each.
MAX_LANGUAGES = 256
UNKNOWN = "und"
#: Code points of texts that are worked on together, unless one text is longer.
AT_ONCE = 1 << 21
#: Places of n-grams that are hashed together.
SLICE = 1 << 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _gram_slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of the texts and the text that each belongs to, those of SLICE places and one size at a time."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) + 1 for p in points])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    chars = np.zeros(sizes.sum() + 1, np.uint32)
    starts = np.cumsum(sizes) - sizes
    for start, p in zip(starts, points):
        chars[start + 1 : start + 1 + len(p)] = p  # a boundary before each text
    letter = _letters()[chars]
    chars[~letter] = 0
    # of a run of boundaries only the first stays, but each text keeps the one before it
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    chars, letter, owner = chars[keep], letter[keep], np.append(owner, len(texts) - 1)[keep]
    for n in GRAM_SIZES:
        for at in range(0, len(chars) - n + 1, SLICE):
            count = min(SLICE, len(chars) - n + 1 - at)
            mixed = np.full(count, n, np.uint32)
            inner = np.ones(count, bool)
            for i in range(n):
                mixed = (mixed ^ chars[at + i : at + i + count]) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
                if n == 1 or 0 < i < n - 1:
                    inner &= letter[at + i : at + i + count]
            if n == 2:
                inner &= letter[at : at + count] | letter[at + 1 : at + 1 + count]
            yield (mixed[inner] & np.uint32(BUCKETS - 1)).astype(np.int32), owner[at : at + count][inner]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All that :func:`_gram_slices` gives, as one."""
    slices = list(_gram_slices(texts))
    return tuple(np.concatenate([s[n] for s in slices]) if slices else np.zeros(0, np.int32) for n in (0, 1))


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of bounded total length, each block with the index of its first."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > AT_ONCE:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, texts[start:]


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def count_grams(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    """``lang, bucket, n`` over all rows; bucket -1 counts the documents. Texts without a letter are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for lang in set(langs):
                own = [t for t, of in zip(texts, langs) if of == lang and _has_letter(t)]
                total = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                if len(counts) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                total[-1] += len(own)
                for _, block in _blocks(own):
                    for buckets, _ in _gram_slices(block):
                        total[:-1] += np.bincount(buckets, minlength=BUCKETS)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(total[at])],
                ["lang", "bucket", "n"],
            )

    rows = docs.select(F.col(text_column), F.col(lang_column)).dropna()
    per_task = in_python(rows).mapInArrow(run, "lang string, bucket int, n long")
    return per_task.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order, and per language the log probabilities of the buckets, with the log prior last."""
    counts = count_grams(docs, text_column, lang_column)
    # at most MAX_LANGUAGES x (BUCKETS + 1) rows
    rows = counts.toPandas()
    langs = sorted(rows["lang"].unique())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    grams = np.zeros((len(langs), BUCKETS + 1))
    index = {lang: i for i, lang in enumerate(langs)}
    grams[rows["lang"].map(index).to_numpy(dtype=int), rows["bucket"].to_numpy()] = rows["n"]  # bucket -1 is the last
    matrix = np.empty_like(grams)
    if not langs:
        return langs, matrix
    inside = grams[:, :-1] + smoothing
    matrix[:, :-1] = np.log(inside) - np.log(inside.sum(axis=1, keepdims=True))
    matrix[:, -1] = np.log(grams[:, -1] + smoothing) - np.log((grams[:, -1] + smoothing).sum())
    return langs, matrix


def predict_texts(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """The most probable language of each text and its posterior probability; ties go to the first in order."""
    out, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and _has_letter(t)] if langs else []
    for first, block in _blocks([texts[i] for i in known]):
        logs = np.tile(matrix[:, -1], (len(block), 1))
        for buckets, owner in _gram_slices(block):
            logs += np.stack([np.bincount(owner, row[buckets], len(block)) for row in matrix[:, :-1]], axis=1)
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        for i, (b, s) in enumerate(zip(best, share)):
            out[known[first + i]], scores[known[first + i]] = langs[b], float(s)
    return out, scores


def identify(
    docs: DataFrame, training: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score``, from what ``training`` says of texts and languages.

    A null text, an empty one, one without a letter, and any text where nothing was learned give ``und`` with score 0.
    Texts of any length are read whole, in slices. Rows that repeat have their own rows; other columns are not read,
    whatever their names. An empty table gives no rows.
    """
    langs, matrix = fit(training, text_column, lang_column)
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = predict_texts(batch.column(1).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return in_python(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def learnable(doc_id: Column, held_out: Column) -> Column:
    """Rows to learn from: outside the held-out fold, with an identifier."""
    return doc_id.isNotNull() & ~held_out
