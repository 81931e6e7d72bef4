import pytest
from conftest import keys, row
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bucketscope.operators.hierarchy import (
    discover_prefixes,
    list_level,
    list_recursive,
    objects_only,
    repartition_by_prefix,
)
from bucketscope.operators.filters import FilterConfig
from bucketscope.plans.listing import listing
from bucketscope.schema import LISTING_SCHEMA


def entries(df):
    return sorted((r["entry_type"], r["key"]) for r in df.collect())


def test_one_prefix_at_the_boundary(rows):
    df = rows(row("p/file1.txt"), row("p/a/file2.txt"), row("p/a/b/file3.txt"))
    assert entries(list_level(df, "p/")) == [("OBJECT", "p/file1.txt"), ("PREFIX", "p/a/")]
    assert entries(objects_only(list_level(df, "p/"))) == [("OBJECT", "p/file1.txt")]
    assert len(keys(list_recursive(df, "p/"))) == 3


def test_prefix_without_slash_matches_siblings(rows):
    df = rows(row("data/a"), row("data-backup/b"), row("data"), row("other"))
    assert entries(list_level(df, "data")) == [("OBJECT", "data"), ("PREFIX", "data-backup/"), ("PREFIX", "data/")]
    assert keys(list_recursive(df, "nothing")) == []
    assert len(keys(list_recursive(df, None))) == 4


def test_marker_rules_at_the_limit(rows):
    df = rows(row("a/"), row("a/x"), row("b/"), row("c"))
    assert entries(list_recursive(df, "", 1)) == [("OBJECT", "c"), ("PREFIX", "a/"), ("PREFIX", "b/")]
    assert entries(list_recursive(df, "", 1, "object")) == [
        ("OBJECT", "a/"), ("OBJECT", "b/"), ("OBJECT", "c"), ("PREFIX", "a/"),
    ]
    for rule in ("rollup", "object"):
        assert ("OBJECT", "a/") in entries(list_recursive(df, "a/", 1, rule))


def test_directory_markers_are_objects(rows):
    df = rows(row("photos/"), row("photos/2025/"), row("photos/2025/img.jpg", 1))
    assert sorted(keys(list_recursive(df, "photos/"))) == ["photos/", "photos/2025/", "photos/2025/img.jpg"]


def test_bad_arguments(rows):
    df = rows(row("a"))
    with pytest.raises(ValueError):
        list_recursive(df, max_depth=0)
    with pytest.raises(ValueError):
        list_recursive(df, max_depth=1, marker="other")
    with pytest.raises(ValueError):
        discover_prefixes(df, depth=0)


def large_tree(spark):
    """16,082 keys: tenants with parts per day, and application logs."""
    parts = spark.range(5 * 2 * 12 * 25 * 5).selectExpr(
        "format_string('data/tenant-%02d/%d/%02d/%02d/part-%03d.parquet', id div 3000 + 1, id div 1500 % 2 + 2024, "
        "id div 125 % 12 + 1, id div 5 % 25 + 1, id % 5 + 1) as key"
    )
    logs = spark.range(2 * 12 * 15 * 3).selectExpr(
        "format_string('logs/app/%d/%02d/%02d/server-%02d/app.log', id div 540 + 2024, id div 45 % 12 + 1, "
        "id div 3 % 15 + 1, id % 3 + 1) as key"
    )
    top = spark.createDataFrame([("config.json",), ("data/manifest.json",)], "key string")
    known = {"bucket": F.lit("b"), "entry_type": F.lit("OBJECT"), "key": F.col("key"), "size": F.lit(1)}
    return parts.union(logs).union(top).select(
        [known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LISTING_SCHEMA.fields]
    )


def test_large_tree(spark):
    df = large_tree(spark)
    assert df.select("key").distinct().count() == 16082
    assert df.select("key").distinct().count() == df.count()
    counts = {r["entry_type"]: r["count"] for r in list_recursive(df, max_depth=3).groupBy("entry_type").count().collect()}
    assert counts == {"OBJECT": 2, "PREFIX": 12}
    found = {r["prefix"]: r["object_count"] for r in discover_prefixes(df, depth=2).collect()}
    assert found["data/"] == 15001 and found["data/tenant-03/"] == 3000 and found["logs/app/"] == 1080
    assert len(found) == 8
    assert repartition_by_prefix(df, 4).count() == 16082


KEY = st.lists(st.sampled_from(["a", "b", "", "c/"]), min_size=1, max_size=5).map("/".join).filter(bool)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(KEY, min_size=5, max_size=30, unique=True), st.integers(1, 3), st.sampled_from(["", "a", "a/"]))
def test_objects_and_what_lies_below_prefixes_are_the_recursive_listing(spark, rows, names, depth, prefix):
    df = rows(*[row(k) for k in names]).cache()
    everything = set(keys(list_recursive(df, prefix)))
    for rule in ("rollup", "object"):
        found = list_recursive(df, prefix, depth, rule).collect()
        shown = {r["key"] for r in found if r["entry_type"] == "OBJECT"}
        below = [r["key"] for r in found if r["entry_type"] == "PREFIX"]
        assert len(below) == len(set(below))
        assert shown | {k for k in everything if any(k.startswith(p) for p in below)} == everything
        if rule == "rollup":
            assert not any(k.startswith(p) for k in shown for p in below)


def test_stages_come_in_order(rows):
    """Directories come from all rows of the mode, then hiding and filters follow."""
    marker = {"entry_type": "DELETE_MARKER", "version_id": "m", "is_latest": True}
    df = rows(row("gone/x", **marker), row("kept/y.csv", 5, version_id="1", is_latest=True), row("top.txt", version_id="2", is_latest=True))
    versions = listing(df, versions=True, hide_markers=True, filters=FilterConfig(include_regex="csv$"))
    assert entries(versions) == [("PREFIX", "gone/"), ("PREFIX", "kept/")]
    assert entries(listing(df)) == [("OBJECT", "top.txt"), ("PREFIX", "kept/")]
    assert entries(listing(df, versions=True, objects_only=True)) == [("OBJECT", "top.txt")]


def test_partitions_by_prefix_hold_bounded_rows(spark):
    df = spark.range(3000).select(F.lit("b").alias("bucket"), F.format_string("k%05d", "id").alias("key"))
    dealt = repartition_by_prefix(df, 8, 100)
    assert dealt.rdd.getNumPartitions() >= 25 and dealt.count() == 3000
    assert repartition_by_prefix(df, 8, 1000).rdd.getNumPartitions() == 8
