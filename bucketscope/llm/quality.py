"""A document classifier with supervised subword embeddings (operator 4).

A document is the average of learned vectors: one per hashed word, per hashed character n-gram of its words, and for
each word that repeats the one before it (the word pair "w w", in a bucket of its own). A softmax layer on the average
gives the classes. Vectors and layer are trained together by stochastic gradient descent in numpy, in one Spark task
over a bounded sample of the labelled documents; whole texts are featurised by the tasks that read them.

For scoring, vectors and layer collapse into one number per bucket, and a word into the sum over its buckets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.llm.common import free_name, in_python

BUCKETS = 1 << 16
DIMENSIONS = 8
GRAM_SIZES = (2, 3, 4)
#: Labelled documents used for training, about: those with the smallest hashes. Of identifiers that repeat, up to twice
#: as many rows. The only bounds on what is learned from.
TRAINING_DOCUMENTS = 5000
EPOCHS = 4
#: Steps at least, so that few labelled documents are seen more often.
LEAST_STEPS = 12_000
RATE = 1.0
#: Distinct words that a task remembers; those of more than LONG_WORD characters by a digest, and their buckets piecewise.
CACHED = 400_000
LONG_WORD = 64
PIECE = 1 << 16
FOLDS = 5


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a document belongs to the fold that is never learned from. A null identifier does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def word_buckets(word: str) -> list[int]:
    """Buckets of a word: of itself, and of the character n-grams of it between boundary marks."""
    crc, mask, marked = zlib.crc32, BUCKETS - 1, f"<{word}>"
    out = [crc(b"w" + word.encode()) & mask]
    if marked.isascii():
        raw = marked.encode()
        out += [crc(raw[i : i + n]) & mask for n in GRAM_SIZES for i in range(len(raw) - n + 1)]
    else:
        out += [crc(marked[i : i + n].encode()) & mask for n in GRAM_SIZES for i in range(len(marked) - n + 1)]
    return out


def pieces(word: str) -> Iterator[list[int]]:
    """The buckets of a word of any length, some at a time."""
    if len(word) <= PIECE:
        yield word_buckets(word)
        return
    crc, mask, marked = zlib.crc32, BUCKETS - 1, f"<{word}>"
    yield [crc(b"w" + word.encode()) & mask]
    for n in GRAM_SIZES:
        for at in range(0, len(marked) - n + 1, PIECE):
            yield [crc(marked[i : i + n].encode()) & mask for i in range(at, min(at + PIECE, len(marked) - n + 1))]


SAME_WORD = zlib.crc32(b"\x00same") & (BUCKETS - 1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of all its features."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    short = [w for w in counts if len(w) <= PIECE]
    each = [word_buckets(w) for w in short]
    weight = np.repeat([counts[w] for w in short], [len(e) for e in each])
    same = sum(a == b for a, b in zip(words, words[1:]))
    total = np.bincount(np.fromiter(chain.from_iterable(each), np.int64), weight, BUCKETS)
    for word in (w for w in counts if len(w) > PIECE):
        for piece in pieces(word):
            total += counts[word] * np.bincount(piece, minlength=BUCKETS)
    total[SAME_WORD] += same
    buckets = np.flatnonzero(total)
    return buckets.astype(np.int32), (total[buckets] / total.sum()).astype(np.float32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 4) -> np.ndarray:
    """Log odds of label 1 per bucket, and the bias as last entry, from (label, buckets, shares)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.zeros(2, np.float32)
    epochs = max(epochs, -(-LEAST_STEPS // max(1, len(rows))))
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for at in rng.permutation(len(rows)):
            label, buckets, shares = rows[at]
            now = np.float32(rate * (1 - step / steps))
            own = vectors[buckets]
            hidden = shares @ own
            logits = hidden @ layer + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = layer @ error
            layer -= now * np.outer(hidden, error)
            bias -= now * np.float32(0.1) * error
            # the average spreads a document's gradient over thousands of rows; rescaled to the size of one of them
            scale = now / max(float(shares @ shares), 1e-6) ** 0.5 if len(shares) else now
            vectors[buckets] = own - scale * shares[:, None] * back
            step += 1
    odds = vectors.astype(np.float64) @ (layer[:, 1] - layer[:, 0]).astype(np.float64)
    return np.append(odds, float(bias[1] - bias[0]))


def training_features(
    docs: DataFrame,
    labels: DataFrame,
    label_column: str = "quality",
    id_column: str = "doc_id",
    text_column: str = "text",
    training_documents: int = TRAINING_DOCUMENTS,
) -> DataFrame:
    """``_id, _label, buckets, shares`` of the documents to learn from, about ``training_documents`` and no more than twice
    as many rows."""
    known = labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_label"))
    # a label is counted once, however many rows say it
    known = known.where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).distinct()
    share = min(1.0, training_documents / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("train"), "_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    # about ``training_documents`` rows of an identifier and a label
    sample = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", "_text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([m[0].tobytes() for m in made], pa.binary()),
                    pa.array([m[1].tobytes() for m in made], pa.binary()),
                ],
                ["_id", "_label", "buckets", "shares"],
            )

    kind = sample.schema["_id"].dataType.simpleString()
    ready = in_python(sample).mapInArrow(featurise, f"_id {kind}, _label int, buckets binary, shares binary")
    # where few identifiers have very many rows: any of them, no more than of as many documents; else this keeps all
    return ready.limit(2 * training_documents)


def fit(docs: DataFrame, labels: DataFrame, **options) -> np.ndarray:
    """A model from the labelled documents outside the held-out fold; the options are those of :func:`training_features`.

    Labels other than 0 and 1, null ones and those without a document are not used; a document with both labels
    counts once for each, and rows that repeat an identifier are documents of their own. Without any, the model scores
    everything 0.5. Columns may have any names beside those given.
    """

    def learn(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*[group.column(c).to_pylist() for c in ("_id", "_label", "buckets", "shares")]))
        model = train([(y, np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for _, y, b, s in rows])
        return pa.table({"model": pa.array([model.tobytes()], pa.binary())})

    ready = training_features(docs, labels, **options)
    found = ready.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "model binary").collect()
    return np.frombuffer(found[0][0], np.float64) if found else np.zeros(BUCKETS + 1)


class Scorer:
    """Scores of whole texts; a word's log odds and number of features are looked up, or worked out once."""

    def __init__(self, model: np.ndarray):
        self.odds, self.bias = model[:-1].tolist(), float(model[-1])
        self.clear()

    def clear(self) -> None:
        self.sums: list[float] = []
        self.sizes: list[int] = []
        self.rows: dict[str, int] = _Rows(self)
        self.ready = 0
        self.table = np.zeros((2, 0))

    def add(self, word: str) -> int:
        total, size = 0.0, 0
        for buckets in pieces(word):
            total, size = total + sum(map(self.odds.__getitem__, buckets)), size + len(buckets)
        self.sums.append(total)
        self.sizes.append(size)
        return len(self.sums) - 1

    def __call__(self, text: str | None) -> float:
        words = (text or "").split()
        total, size = 0.0, 0
        if words:
            if len(self.sums) > CACHED:
                self.clear()
            rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            if self.ready < len(self.sums):
                new = np.array([self.sums[self.ready :], self.sizes[self.ready :]])
                self._extend(new)
            total, size = self.table[:, rows].sum(axis=1)
            same = int((rows[1:] == rows[:-1]).sum())
            total, size = total + same * self.odds[SAME_WORD], size + same
        z = self.bias + (total / size if size else 0.0)
        return float(1 / (1 + np.exp(-z)))

    def _extend(self, new: np.ndarray) -> None:
        end = self.ready + new.shape[1]
        if end > self.table.shape[1]:
            grown = np.zeros((2, max(2 * end, 1024)))
            grown[:, : self.ready] = self.table[:, : self.ready]
            self.table = grown
        self.table[:, self.ready : end] = new
        self.ready = end


class _Rows(dict):
    def __init__(self, scorer: Scorer):
        self.scorer = scorer

    def __missing__(self, word: str) -> int:
        if len(word) <= LONG_WORD:
            found = self[word] = self.scorer.add(word)
            return found
        digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        found = self.get(digest)
        if found is None:
            found = self[digest] = self.scorer.add(word)
        return found


def score(docs: DataFrame, model: np.ndarray, text_column: str = "text", name: str = "score") -> DataFrame:
    """The rows with the probability of label 1 in a new last column. Null and empty texts get the bias alone."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column {name}")
    # (buckets + 1) numbers
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = pa.array([scorer(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [f.name for f in schema.fields])

    return in_python(docs).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **columns: str) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``. An empty table gives no rows."""
    id_column, text_column = columns.get("id_column", "doc_id"), columns.get("text_column", "text")
    model = fit(docs, labels, **columns)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    scored = score(rows, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    name = free_name(docs.columns, "_score")
    scored = score(docs, fit(docs, labels), name=name)
    return scored.where(F.col(name) >= threshold).drop(name)
