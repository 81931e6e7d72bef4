"""Whitening against plain integer arithmetic and numpy."""

import math
import random

import numpy as np
import pytest

from bucketscope.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n int, component string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, None) for i, v in rows], SCHEMA)


def numbers(rows):
    return [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check(rows, found, most=4):
    by_dim = {}
    for i, x in numbers(rows):
        by_dim.setdefault(len(x), []).append((i, x))
    by_dim.pop(0, None)
    wanted = sorted((str(i), c) for dim, own in by_dim.items() for i, _ in own for c in range(1, min(most, dim) + 1))
    assert sorted((str(r["vec_id"]), r["component"]) for r in found) == wanted
    for dim, own in by_dim.items():
        fit = sorted({x for _, x in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        scatter = [[n * sum(v[a] * v[b] for v in fit) - sums[a] * sums[b] for b in range(dim)] for a in range(dim)]
        covariance = np.array([[v / (n * n) for v in row] for row in scatter])
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        trace = np.trace(covariance)
        for i, x in own:
            if [j for j, y in rows if j == i] != [i]:
                continue
            mine = {r["component"]: r for r in found if r["vec_id"] == i}
            for c in range(min(most, dim)):
                r = mine[c + 1]
                deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
                assert r["n"] == n and r["deviation"] == (deviation if deviation < 1 << 63 else None)
                assert r["identity_error"] <= 1e-4
                if values[c] <= dim * 3e-16 * max(values[0], 0):
                    assert r["whitened"] is None and r["explained"] == 0
                    continue
                assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
                projected = sum((a - s / n) * w for a, s, w in zip(x, sums, vectors[:, c])) / math.sqrt(values[c])
                gaps = [abs(values[c] - v) for k, v in enumerate(values) if k != c]
                if min(gaps, default=1) > 1e-6 * values[0]:
                    assert abs(r["whitened"]) == pytest.approx(abs(projected), rel=1e-6, abs=1e-6)


def test_whitening_agrees_with_plain_arithmetic(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1 + d) for d in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(150)] + [(1, rows[0][1]), (None, rows[5][1])]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [NAN] * 6), (2003, [INF] + [0.0] * 5), (2004, [])]
    rows += [(2005, [-0.0] * 6), (2006, [0.003] * 6), (2007, [1.0, 2.0]), (2008, [1.5, -2.0]), (2009, [0.0, 0.0]), (2010, [9.0])]
    found = whitening.whiten(table(spark, rows).repartition(5)).collect()
    check(rows, found)
    assert len({r["identity_error"] for r in found if r["n"] > 10}) == 1


def test_one_sign_for_all_rows_and_unit_variance(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 5)) @ np.diag([9.0, 5.0, 2.0, 1.0, 0.5])
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    found = whitening.whiten(table(spark, rows)).collect()
    white = np.zeros((400, 4))
    for r in found:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(white.T @ white / 400 - np.eye(4)).max() < 1e-6


@pytest.mark.parametrize("rows", [
    [], [(1, [0.5, 1.0])], [(i, [1.0, 1.0, 1.0]) for i in range(50)], [(1, [1.0, 2.0]), (2, [2.0, 4.0])],
    [(i, [float(i), 5.0, -float(i)]) for i in range(20)], [(1, [1e15, 1.0]), (2, [-1e15, 2.0]), (3, [3e14, 9.0])],
])
def test_few_and_flat_vectors(spark, rows):
    check(rows, whitening.whiten(table(spark, rows)).collect())


@pytest.mark.parametrize("reach", [1, 300, 1 << 20, 1 << 62])
def test_bit_products_are_exact(reach):
    rng = random.Random(reach)
    rows = [[rng.randrange(-reach, reach) for _ in range(5)] + [7, -reach] for _ in range(131)]
    found = whitening.cross_products(np.array(rows, np.int64))
    whole = [[*r, 1] for r in rows]
    assert found.tolist() == [[sum(r[a] * r[b] for r in whole) for b in range(8)] for a in range(8)]


def test_blocks_and_tasks_add_up(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PLANE_BYTES", 1)
    rng = random.Random(9)
    rows = [[rng.randrange(-500, 500) for _ in range(4)] for _ in range(700)]
    listed = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(3)
    found = whitening.scatter(listed)
    whole = [[*r, 1] for r in rows]
    assert found[4].tolist() == [[sum(r[a] * r[b] for r in whole) for b in range(5)] for a in range(5)]
