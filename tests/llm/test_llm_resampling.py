"""Importance resampling against brute force, with small heads and chunks."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from bucketscope.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank int, score string, weight string, n_words string, bucket int, _place int"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def features(text, max_words=1):
    found = words(text)
    out = [w.encode() for w in found]
    if max_words > 1:
        out += [f"{a} {b}".encode() for a, b in zip(found, found[1:])]
    return [zlib.crc32(f) % 10_000 for f in out]


def brute(docs, target, max_words=1, least=20, percent=10):
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text in docs:
        np.add.at(s, features(text, max_words), 1)
    for text in target:
        np.add.at(t, features(text, max_words), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        own = features(text, max_words)
        weight = sum(gain[b] for b in own)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(words(text)), len(own), weight, score, None])
    eligible = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for place, row in enumerate(eligible[: len(eligible) * percent // 100], 1):
        row[5] = place
    return sorted(map(tuple, rows), key=str)


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "Wort", "中文字", "é", "x1", "ÄÖ", "café", "٣", "A", "z" * 90] + [f"w{i}" for i in range(200)]
    seps = [" ", ", ", "\n", "--", "\x00", "_", "\x7f", ". "]
    make = lambda k: "".join(rng.choice(vocabulary[: rng.randrange(1, 210)]) + rng.choice(seps) for _ in range(k))
    rows = [(i, make(rng.randrange(0, 90))) for i in range(n)]
    same = make(60)
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "!?  \t"), (n + 4, make(4000)), (None, make(50)), (n + 5, "。" * 500)]
    rows += [(n + 10 + i, same) for i in range(120)] + [(n + 6, make(40))] * 9 + [(7, make(30)), (7, make(30))]
    return rows, [make(30) for _ in range(20)] + [None, ""]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "w", "n", 2, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("max_words", [1, 2])
def test_ranks_agree_with_brute_force(spark, monkeypatch, max_words):
    # a small head: most features go the direct way
    monkeypatch.setattr(resampling, "HEAD_WORDS", 20)
    monkeypatch.setattr(resampling, "HEAD_PAIRS", 30)
    monkeypatch.setattr(resampling, "CANDIDATES", 100)
    rows, target = corpus()
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    found = resampling.importance_ranks(table(spark, rows), wanted, max_words=max_words)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, target, max_words)


def test_the_head_decides_no_result(spark):
    rows, target = corpus(80, seed=8)
    texts = pa.array([(t or "").encode() for _, t in rows])
    heads = [
        resampling.Head.of([], []), resampling.Head.of([b"the", b"w1"], [b"the w1", b"w1 the", b"w9 w8"]),
        resampling.Head.of([f"w{i}".encode() for i in range(200)], [f"w{i} w{j}".encode() for i in range(40) for j in range(40)]),
    ]
    for max_words in (1, 2):
        totals = []
        for head in heads:
            parts = list(head.features(texts, max_words))
            row, bucket = (np.concatenate([p[n] for p in parts]) for n in (0, 1))
            totals.append([sorted(bucket[row == i].tolist()) for i in range(len(rows))])
        assert totals[0] == totals[1] == totals[2] == [sorted(features(t, max_words)) for _, t in rows]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_long_texts_are_cut_between_words(monkeypatch, size):
    rng = random.Random(size)
    texts = ["", "x" * 50 + " y", "。" * 40, " " * 30, "".join(rng.choice(["ab", "c ", ", ", "é", "longerword "]) for _ in range(400)), "last"]
    column = pa.array([t.encode() for t in texts])
    head = resampling.Head.of([b"ab"], [])
    monkeypatch.setattr(resampling, "CHUNK_BYTES", size)
    cut = [(r, w, c) for r, w, c in resampling.chunks(column, size)]
    assert len(cut) > 5 or size > 1000
    found = [[] for _ in texts]
    for row, chunk, _ in cut:
        for own, word in zip(chunk.row.tolist(), chunk.words.to_pylist()):
            found[row + own].append(word.decode())
    assert found == [words(t) for t in texts]
    monkeypatch.setattr(resampling, "chunks", lambda texts, real=resampling.chunks: real(texts, size))
    parts = list(head.features(column, 2))
    row, bucket = (np.concatenate([p[n] for p in parts]) for n in (0, 1))
    assert [sorted(bucket[row == i].tolist()) for i in range(len(texts))] == [sorted(features(t, 2)) for t in texts]


def test_sliced_columns():
    whole = pa.array([b"one two", b"three", None, b"four five six"]).fill_null(b"")
    sliced = whole.slice(1, 3)
    found = [(r + own, w) for r, c, _ in resampling.chunks(sliced) for own, w in zip(c.row.tolist(), c.words.to_pylist())]
    assert found == [(0, b"three"), (2, b"four"), (2, b"five"), (2, b"six")]


def test_empty_tables(spark):
    rows, target = corpus(30)
    docs, wanted = table(spark, rows), spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    assert resampling.importance_ranks(docs.limit(0), wanted).collect() == []
    found = resampling.importance_ranks(docs, wanted.limit(0)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, [])
    for bad in ({"max_words": 3}, {"percent": 101}):
        with pytest.raises(ValueError):
            resampling.importance_ranks(docs, wanted, **bad)


def test_documents_drawn_keep_their_columns(spark):
    rows, target = corpus(200)
    docs, wanted = table(spark, rows), spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    drawn = resampling.resampled(docs, wanted)
    assert drawn.columns == docs.columns
    ids = {r[0] for r in brute(rows, target) if r[5]}
    assert {r["doc_id"] for r in drawn.collect()} == ids
