"""File-level index: listings open the files that can match, and lose no row."""

import datetime as dt
import os
import random

import pytest
from conftest import DAY, row
from pyspark.sql import functions as F

from bucketscope.operators.filters import FilterConfig, apply_filters
from bucketscope.schema import LISTING_SCHEMA
from bucketscope.sources import manifest
from bucketscope.sources.targets import under

CLASSES = [None, "STANDARD", "GLACIER", "STANDARD_IA"]


def entries(rows, n=400, seed=1, **fixed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        values = {"bucket": f"b{i * 4 // n}", "size": i, "storage_class": CLASSES[i * 4 // n], "last_modified": DAY + dt.timedelta(days=i)} | fixed
        out.append(row(f"{'abcdé'[i % 5]}/{rng.randrange(9)}/k{i}", **values))
    return rows(*out)


@pytest.fixture
def stored(rows, tmp_path):
    path = str(tmp_path / "inventory")
    manifest.store_inventory(entries(rows), path, 12)
    return path


ASKED = [
    ("b1", None, FilterConfig()), ("b1", "a/", FilterConfig()), (None, "é/3", FilterConfig()), ("b9", None, FilterConfig()),
    (None, None, FilterConfig(larger_size=390)), (None, None, FilterConfig(smaller_size="10B", larger_size=3)),
    (None, None, FilterConfig(mtime_before=DAY + dt.timedelta(days=20))), ("b3", "b", FilterConfig(mtime_after=DAY + dt.timedelta(days=380))),
    (None, None, FilterConfig(storage_class=("GLACIER",))), (None, None, FilterConfig(storage_class=("STANDARD",))),
    (None, None, FilterConfig(include_regex="^c/1/", larger_size=7)), ("b0", None, FilterConfig(exclude_regex="k")),
    ("b2", "d/", FilterConfig(include_regex="k2", storage_class=("GLACIER", "STANDARD_IA"), larger_size="1KiB")),
]


def expected(spark, path, bucket, prefix, filters):
    whole = spark.read.schema(LISTING_SCHEMA).parquet(path)
    whole = whole if bucket is None else whole.where(F.col("bucket") == bucket)
    return sorted(map(str, apply_filters(under(whole, prefix), filters).collect()))


@pytest.mark.parametrize("bucket, prefix, filters", ASKED)
def test_fewer_files_give_the_same_rows(spark, stored, bucket, prefix, filters):
    found = manifest.scan(spark, stored, bucket, prefix, filters)
    assert sorted(map(str, found.collect())) == expected(spark, stored, bucket, prefix, filters)
    if (bucket, prefix, filters) != ("b0", None, FilterConfig(exclude_regex="k")):
        assert len(manifest.choose_files(spark, stored, bucket, prefix, filters)) < 12


def test_only_files_that_can_match_are_opened(spark, stored):
    names = {os.path.basename(f) for f in manifest.choose_files(spark, stored, "b1", "a/")}
    holding = spark.read.parquet(stored).where("bucket = 'b1' and key like 'a/%'").select(F.input_file_name().alias("f")).distinct()
    needed = {os.path.basename(r["f"]) for r in holding.collect()}
    # a file in which one bucket ends and the next begins covers more than it holds
    assert needed <= names and len(names) <= len(needed) + 2
    assert {os.path.basename(f) for f in manifest.scan(spark, stored, "b1", "a/").inputFiles()} == names
    assert manifest.choose_files(spark, stored, "none") == [] and manifest.scan(spark, stored, "none").count() == 0


def test_directories_and_markers_pass_filters_about_stored_bytes(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    listed = rows(row("a"), row("m", entry_type="DELETE_MARKER", last_modified=DAY), row("p/", entry_type="PREFIX"))
    manifest.store_inventory(listed.repartition(1), path, 3)
    for filters in (FilterConfig(larger_size=10), FilterConfig(storage_class=("GLACIER",)), FilterConfig(mtime_after=DAY + dt.timedelta(days=1)), FilterConfig(include_regex="^x")):
        assert sorted(map(str, manifest.scan(spark, path, filters=filters).collect())) == expected(spark, path, None, None, filters)


def test_files_that_the_index_does_not_know_are_read(spark, rows, stored):
    entries(rows, 40, 2, bucket="b1").write.mode("append").parquet(stored)
    asked = ("b1", "a/", FilterConfig())
    assert sorted(map(str, manifest.scan(spark, stored, *asked).collect())) == expected(spark, stored, *asked)
    before = len(manifest.choose_files(spark, stored, "none"))
    manifest.write_manifest(spark, stored)
    assert before > 0 and manifest.choose_files(spark, stored, "none") == []
    assert manifest.read_manifest(spark, stored).groupBy("file").count().where("count > 1").count() == 0
    assert manifest.read_manifest(spark, stored).agg(F.sum("rows")).first()[0] == 440


def test_an_inventory_without_an_index_is_read_whole(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    entries(rows).write.parquet(path)
    assert manifest.read_manifest(spark, path) is None
    asked = ("b1", "a/", FilterConfig(larger_size=5))
    assert sorted(map(str, manifest.scan(spark, path, *asked).collect())) == expected(spark, path, *asked)


def test_ranges_of_a_footer(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    rows(row("é", 5), row("a", 9, storage_class="GLACIER")).coalesce(1).write.parquet(path)
    manifest.write_manifest(spark, path)
    (found,) = manifest.read_manifest(spark, path).collect()
    assert (found["rows"], found["least_key"], found["most_key"], found["least_size"], found["most_size"]) == (2, "a", "é", 5, 9)
    assert (found["nulls_storage_class"], found["least_storage_class"], found["most_storage_class"]) == (1, "GLACIER", "GLACIER")
