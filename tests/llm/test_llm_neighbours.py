"""Nearest neighbours: recall, exact scores, ties, and what takes no part."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketscope.llm import neighbours
from bucketscope.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, id int, bucket string"


def brute(rows, k, is_query):
    usable = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in usable:
        if is_query(q):
            scores = []
            for c, y in usable:
                if c != q and len(x) == len(y):
                    dot = own = other = 0.0
                    for a, b in zip(x.tolist(), y.tolist()):
                        dot, own, other = dot + a * b, own + a * a, other + b * b
                    scores.append((-(dot / (math.sqrt(own) * math.sqrt(other))), c))
            out[q] = [(c, -s) for s, c in sorted(set(scores))[:k]]
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_of_the_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    wanted = brute(rows, 5, lambda i: i % 50 == 0)
    found = results(QUERIES["op2_neighbours"](spark, sf_dir))
    assert found.keys() == wanted.keys() and all(len(f) == 5 for f in found.values())
    hits = sum(len({c for c, _ in wanted[q]} & {c for c, _ in found[q]}) for q in wanted)
    assert hits >= 0.9 * 5 * len(wanted)
    exact = {(q, c): s for q in wanted for c, s in brute(rows, len(rows), lambda i: i == q)[q]}
    assert all(exact[q, c] == s for q, f in found.items() for c, s in f)


def test_small_and_odd_tables_are_searched_whole(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0, 2.0], 1, 1, "x"), (1, [1.0, 0.0, 2.0], None, None, None), (2, [2.0, 0.0, 4.0], 1, 1, "x"),
        (3, [0.0, 0.0, 0.0], 1, 1, "x"), (4, None, 1, 1, "x"), (5, [1.0, None, 0.0], 1, 1, "x"), (6, [1.0, inf, 0.0], 1, 1, "x"),
        (7, [1.0, nan, 0.0], 1, 1, "x"), (8, [], 1, 1, "x"), (9, [-1.0, 0.5, 0.0], 1, 1, "x"), (10, [1.0, 1.0], 1, 1, "x"),
        (11, [5.0], 1, 1, "x"), (12, [3.0, 1.0, 0.0], 1, 1, "x"), (12, [3.0, 1.0, 0.0], 1, 1, "x"), (None, [1.0, 0.0, 2.0], 1, 1, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = results(neighbours.nearest_neighbours(df, F.lit(True)))
    wanted = {q: f for q, f in brute(rows, 5, lambda _: True).items() if f}
    assert found == wanted and [c for c, _ in found[0]][:2] == [1, 2]
    assert results(neighbours.nearest_neighbours(df.limit(0), F.lit(True))) == {}


def test_blocks_of_a_large_bucket_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 4)
    rng = random.Random(3)
    rows = [(i, [1.0 + rng.choice([0.0, 0.01, 0.02]), 0.5, rng.choice([0.0, 0.1]), 0.0, 0.2], 1, 1, "x") for i in range(200)]
    found = results(neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0))
    assert found == brute(rows, 5, lambda i: i % 10 == 0)


def by_id(rows, k, is_query):
    """As brute(), where each pair of identifiers has the best score of their rows."""
    scores = {}
    for n, (q, *_) in enumerate(rows):
        if is_query(q):
            own = [rows[n], *[r for r in rows if r[0] != q]]
            for c, s in brute(own, len(rows), lambda i, q=q: i == q)[q]:
                scores.setdefault(q, {})[c] = max(s, scores.get(q, {}).get(c, -2.0))
    return {q: sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k] for q, found in scores.items()}


@pytest.mark.parametrize("block", [16, 4096])
def test_repeated_identifiers_take_one_place_each(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    rng = random.Random(5)
    vector = lambda: [1.0 + rng.choice([0.0, 0.25, 0.5]), 0.5, rng.choice([0.0, 0.125]), rng.random() / 4, 0.25]
    rows = [(i, vector(), 1, 1, "x") for i in (0, 10, 20)]
    for i in range(31, 60):
        same = vector()
        near = lambda: [same[0] + rng.random() / 1000, *same[1:]]  # noqa: B023, E731
        rows += [(i, same if i % 2 else near(), 1, 1, "x") for _ in range(7)]
    rows += [(99, vector(), 1, 1, "x") for _ in range(100)]  # a third of all rows
    found = results(neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") <= 20))
    wanted = by_id(rows, 5, lambda i: i <= 20)
    assert found == wanted and all(len(f) == 5 for f in found.values())


def test_rotations_keep_lengths():
    rows = np.random.default_rng(1).normal(size=(20, 37))
    turned = neighbours.rotated(rows, 0, 2)
    assert turned.shape == (20, 64) and np.allclose((turned**2).sum(axis=1), 1)
    assert np.allclose(turned @ turned.T, (rows / np.linalg.norm(rows, axis=1)[:, None]) @ (rows / np.linalg.norm(rows, axis=1)[:, None]).T)
    assert neighbours.nearest_axes(rows, 0, 2, 5).shape == (20, 5)
    assert neighbours.rotated(np.ones((1, 1)), 0, 2).shape == (1, 1)


@pytest.mark.parametrize("width", [1, 2, 8])
def test_transform_is_its_own_inverse(width):
    rows = np.random.default_rng(width).normal(size=(3, width))
    assert np.allclose(neighbours.hadamard(neighbours.hadamard(rows)), rows)


def test_components_whose_squares_overflow_or_vanish(spark):
    rows = [(0, [1e200, 2e200, 0.0]), (1, [1e-200, 2e-200, 0.0]), (2, [3.0, 6.0, 0.0]), (3, [-1e300, 1e300, 1e300]), (4, [0.0, 0.0, 1e-320]), (5, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = results(neighbours.nearest_neighbours(df, F.col("vec_id") == 0))
    assert [i for i, _ in found[0]] == [1, 2, 3, 4]
    assert [s for _, s in found[0]] == pytest.approx([1.0, 1.0, 1 / 15**0.5, 0.0])
