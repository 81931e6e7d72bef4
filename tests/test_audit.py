import math
import random
from collections import Counter

import pytest
from conftest import row

from bucketscope import session
from bucketscope.operators.audit import (
    audit_pages,
    differing_prefixes,
    estimate_requests,
    level_requests,
    reconcile,
    reconcile_by_prefix,
)
from bucketscope.operators.hierarchy import list_level
from bucketscope.schema import PAGE_LOG_SCHEMA


def requests(df):
    return {r["bucket"]: r["requests"] for r in df.collect()}


def test_sequential_estimate(spark, rows):
    df = rows(*[row(f"k{n}") for n in range(21)], row("one", bucket="c"))
    assert requests(estimate_requests(df, max_keys=10)) == {"b": 3, "c": 1}
    idle = spark.createDataFrame([("b",), ("empty",)], "bucket string")
    assert requests(estimate_requests(df, max_keys=10, buckets=idle)) == {"b": 3, "c": 1, "empty": 1}
    folded = rows(*[row(f"d{n % 3}/k{n}") for n in range(30)], row("x"))
    assert requests(estimate_requests(list_level(folded), max_keys=2)) == {"b": 2}
    with pytest.raises(ValueError):
        estimate_requests(df, max_keys=0)


def brute(keys, depth, max_keys):
    """Requests of a parallel listing by walking the directories."""

    def walk(prefix, level):
        below = [k for k in keys if k.startswith(prefix)]
        if level > depth:
            return max(1, math.ceil(len(below) / max_keys))
        rest = [k[len(prefix):] for k in below]
        children = {r[: r.index("/") + 1] for r in rest if "/" in r}
        here = sum("/" not in r for r in rest) + len(children)
        return max(1, math.ceil(here / max_keys)) + sum(walk(prefix + c, level + 1) for c in children)

    return walk("", 0)


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
@pytest.mark.parametrize("max_keys", [1, 3, 1000])
def test_parallel_estimate_agrees_with_a_walk(rows, depth, max_keys):
    keys = [f"{'/'.join(str(n * p % 4) for p in range(1, n % 5 + 1))}/f{n}".lstrip("/") for n in range(60)] + ["1/", "0//x"]
    df = rows(*[row(k, entry_type="DELETE_MARKER" if n % 7 == 0 else "OBJECT") for n, k in enumerate(keys)])
    assert requests(estimate_requests(df, max_keys, parallel_depth=depth)) == {"b": brute(keys, depth, max_keys)}


def test_requests_per_level(rows):
    df = rows(row("a/1"), row("a/2"), row("b/c/3"), row("top"))
    found = {r["prefix"]: (r["level"], r["entries"]) for r in level_requests(df, parallel_depth=1).collect()}
    assert found == {"": (0, 3), "a/": (1, 2), "b/": (1, 1), "b/c/": (2, 1)}


def page(mode, number, truncated, token=None, marker=None, version=None, bucket="b"):
    return (bucket, None, mode, number, truncated, token, marker, version)


def test_page_chains(spark):
    pages = [
        page("objects", 0, True, "t1"),
        page("objects", 1, True, "t2"),
        page("objects", 2, True, "t2"),
        page("objects", 4, True, None),
        page("objects", 5, False, None),
        page("objects", 0, True, "t2", bucket="other"),
        page("versions", 0, True, None, "k", "1"),
        page("versions", 1, True, None, "k", "2"),
        page("versions", 2, True, None, "k", "2"),
        page("versions", 3, True, None, "m", None),
        page("versions", 4, True, None, "m", None),
        page("versions", 5, True, None, None, "x"),
        page("buckets", 0, None, "t"),
        page("buckets", 1, None, "t"),
        page("buckets", 2, None, ""),
        page("buckets", 3, None, ""),
    ]
    found = {
        (r["mode"], r["page_no"]): r["problem"] for r in audit_pages(spark.createDataFrame(pages, PAGE_LOG_SCHEMA)).collect()
    }
    assert found == {
        ("objects", 2): "repeated_token",
        ("objects", 4): "missing_token",
        ("versions", 2): "repeated_token",
        ("versions", 4): "repeated_token",
        ("versions", 5): "missing_token",
        ("buckets", 1): "repeated_token",
    }


def test_reconcile(rows):
    expected = rows(*[row(k) for k in ("same", "gone", "twice", "thinned", "thinned")])
    actual = rows(*[row(k) for k in ("same", "twice", "twice", "new", "thinned")])
    found = {r["key"]: (r["status"], r["expected_count"], r["actual_count"]) for r in reconcile(expected, actual).collect()}
    assert found == {
        "gone": ("missing", 1, 0), "twice": ("duplicate", 1, 2), "new": ("unexpected", 0, 1), "thinned": ("missing", 2, 1),
    }
    assert Counter(found) and reconcile(expected, expected).count() == 0


def _keys(spark, n, seed=1):
    rng = random.Random(seed)
    return [(f"b{i % 3}", f"{rng.choice('xyz')}/{rng.randrange(4)}/{rng.choice(['', 'd/'])}k{i}", f"v{i}") for i in range(n)]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_only_directories_that_differ_are_compared(spark, limit):
    schema = "bucket string, key string, version_id string"
    first = _keys(spark, 600)
    second = [r for i, r in enumerate(first) if i not in (17, 400)] + [first[3], ("b1", "x/new/k", "v"), ("b0", "top", None)]
    # two versions change places, one value moves to another column, a row without a version
    swapped = [(b, k, "v6" if v == "v9" else "v9" if v == "v6" else v) for b, k, v in second]
    expected, actual = spark.createDataFrame(first, schema), spark.createDataFrame(swapped, schema)
    plain = sorted(map(str, reconcile(expected, actual).collect()))
    for depth in (1, 2, 5):
        assert sorted(map(str, reconcile_by_prefix(expected, actual, depth=depth, broadcast_bytes=limit).collect())) == plain
    keys = [(r["bucket"], r["key"]) for r in reconcile(expected, actual).collect()]
    wanted = {(b, n, "/".join(k.split("/")[:n]) + "/" if n else "") for b, k in keys for n in range(min(k.count("/"), 2) + 1)}
    assert {tuple(r) for r in differing_prefixes(expected, actual).collect()} == wanted
    within = reconcile_by_prefix(expected, actual, prefix="x/").collect()
    assert sorted(map(str, within)) == sorted(s for s in plain if "key='x/" in s)


def test_equal_inventories_shuffle_no_key(spark):
    schema = "bucket string, key string, version_id string"
    rows = _keys(spark, 300)
    expected, actual = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema).repartition(5)
    found = reconcile_by_prefix(expected, actual)
    assert found.collect() == [] and differing_prefixes(expected, actual).collect() == []
    assert found.columns == reconcile(expected, actual).columns
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "Scan" not in plan


def test_reconciling_counts_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    schema = "bucket string, key string, version_id string"
    expected = spark.createDataFrame([("b", f"d{i % 3}/{i}", None) for i in range(2000)], schema)
    actual = spark.createDataFrame([("b", f"d{i % 3}/{i}", None) for i in range(1000, 3000)], schema)
    for found in (reconcile(expected, actual), reconcile_by_prefix(expected, actual)):
        assert len(found.inputFiles()) >= 35
        assert sorted((r["key"].split("/")[1], r["status"]) for r in found.collect()) == sorted(
            [(str(i), "missing") for i in range(1000)] + [(str(i), "unexpected") for i in range(2000, 3000)]
        )
