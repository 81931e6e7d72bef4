import datetime as dt
import os
import random

import pytest
from conftest import DAY, keys, row
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bucketscope.plans import ranges
from bucketscope.sources import inventory, tree
from bucketscope.sources import targets as target_source
from bucketscope.sources.targets import format_target, parse_target, under, under_targets


def parsed(spark, uri, **options):
    at = spark.createDataFrame([(uri,)], "u string").select(parse_target(F.col("u"), **options).alias("at"))
    return at.select("at.*", format_target(F.col("at.bucket"), F.col("at.prefix")).alias("shown")).first()


@pytest.mark.parametrize(
    "uri, bucket, prefix, shown",
    [
        ("s3://b", "b", None, "s3://b"),
        ("s3://b/", "b", None, "s3://b"),
        ("s3://b/p", "b", "p", "s3://b/p"),
        ("s3://b/p/q/", "b", "p/q/", "s3://b/p/q/"),
        ("s3://b//p", "b", "/p", "s3://b//p"),
        ("s3://b/p\nq", "b", "p\nq", "s3://b/p\nq"),
    ],
)
def test_targets(spark, uri, bucket, prefix, shown):
    assert tuple(parsed(spark, uri)) == (bucket, prefix, shown)


@pytest.mark.parametrize("uri", ["s3://", "s3:///p", "http://b/p", "b", None])
def test_bad_targets(spark, uri):
    with pytest.raises(PySparkException):
        parsed(spark, uri)
    assert parsed(spark, uri, on_error="null")["bucket"] is None


def test_prefix_is_literal_and_reaches_the_scan(spark, rows, tmp_path):
    df = rows(row("a*b/1"), row("aXb/2"), row("a%"))
    assert keys(under(df, "a*b")) == ["a*b/1"]
    assert keys(under(df, "a%")) == ["a%"]
    path = str(tmp_path / "t")
    df.write.parquet(path)
    plan = under(spark.read.parquet(path), "a*b/")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,a*b/)" in plan


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_many_targets(spark, rows, limit):
    df = rows(*[row(k, bucket=b) for b in ("x", "y") for k in ("data/1", "data-old/2", "logs/é/3", "d")])
    wanted = [("x", "data"), ("x", "data/"), ("x", "data"), ("y", None), ("y", "logs/é"), ("z", "data"), ("x", "none")]
    targets = spark.createDataFrame(wanted, "bucket string, prefix string")
    found = under_targets(df, targets, broadcast_bytes=limit)
    brute = sorted(
        (b, p or "", k)
        for b, p in set(wanted)
        for b2, k in [(r["bucket"], r["key"]) for r in df.collect()]
        if b == b2 and k.startswith(p or "")
    )
    assert sorted((r["bucket"], r["target_prefix"], r["key"]) for r in found.collect()) == brute
    assert under_targets(df, targets.filter("false")).count() == 0


RAW = "bucket string, key string, size bigint, last_modified timestamp, e_tag string, owner_id string, version_id string, is_latest boolean"


def test_normalisation(spark):
    raw = spark.createDataFrame(
        [
            ("b", "k", None, DAY, None, "o", None, None),
            ("b", "n", -4, DAY, '"e"', None, "v", True),
            ("b", None, 1, DAY, "e", None, "v", True),
            ("b", "nodate", 1, None, "e", None, "v", True),
        ],
        RAW,
    )
    first, second = inventory.normalize_versions(raw).collect()
    assert (first["size"], first["e_tag"], first["version_id"], first["is_latest"]) == (0, "", "null", False)
    assert (second["size"], second["e_tag"], second["version_id"], second["is_latest"]) == (0, '"e"', "v", True)
    assert first["checksum_algorithm"] == [] and first["owner_id"] == "o" and first["entry_type"] == "OBJECT"
    plain = inventory.normalize_objects(raw).collect()
    assert [(r["version_id"], r["is_latest"]) for r in plain] == [(None, None)] * 2
    markers = inventory.normalize_delete_markers(raw.drop("size", "e_tag")).collect()
    assert [(r["entry_type"], r["size"], r["version_id"]) for r in markers] == [("DELETE_MARKER", 0, "null"), ("DELETE_MARKER", 0, "v")]


def test_restore_expiry_becomes_text(spark):
    raw = spark.createDataFrame([("b", "k", 1, DAY, DAY)], "bucket string, key string, size long, last_modified timestamp, restore_expiry_date timestamp")
    assert inventory.normalize_objects(raw).first()["restore_expiry_date"] == "2024-01-15T10:30:00Z"


def test_optional_attributes_leave_the_scan(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    rows(row("k", owner_id="o", is_restore_in_progress=True)).write.parquet(path)
    stored = spark.read.parquet(path)
    kept = inventory.with_optional(stored)
    assert kept.first()["owner_id"] is None and kept.first()["is_restore_in_progress"] is None
    assert "owner_id" not in kept._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert inventory.with_optional(stored, versions=True).first()["owner_id"] == "o"
    assert inventory.with_optional(stored, restore=True).first()["is_restore_in_progress"] is True


def test_one_bucket(rows):
    df = rows(row("k", bucket="x"), row("k", bucket="y"))
    assert inventory.objects(df, "x").count() == 1 and inventory.versions(df).count() == 2


def test_directory_buckets_have_no_owner(spark):
    df = spark.createDataFrame([("a--x-s3", "o"), ("b", "o")], "name string, owner_id string")
    found = inventory.directory_buckets(df).collect()
    assert [(r["name"], r["owner_id"]) for r in found] == [("a--x-s3", None)]


@pytest.mark.parametrize("depth, tasks", [(0, 4), (1, 2), (2, 1024), (5, 3)])
def test_tree_lists_every_file_once(spark, tmp_path, depth, tasks):
    names = ["top", "_hidden", ".dot", "a/1", "a/b/2", "a/b/c/3", "a/_x/4", "d/é\n5"]
    for n, name in enumerate(names):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x" * n)
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    (tmp_path / "empty").mkdir()
    tree.register(spark)
    df = spark.read.format("object_tree").options(path=str(tmp_path), depth=depth, tasks=tasks).load()
    found = {r["key"]: (r["size"], r["last_modified"].timestamp()) for r in df.collect()}
    assert df.count() == len(names)
    assert found == {name: (n, 1_700_000_000 + n) for n, name in enumerate(names)}
    assert df.rdd.getNumPartitions() <= tasks


def test_tree_of_nothing(spark, tmp_path):
    tree.register(spark)
    assert spark.read.format("object_tree").option("path", f"file://{tmp_path}").load().count() == 0


def test_instants_do_not_depend_on_the_local_zone():
    assert dt.datetime.fromtimestamp(1_700_000_000, dt.timezone.utc).year == 2023


@pytest.mark.parametrize("form", ["parquet", "orc", "json"])
def test_inventory_files(spark, rows, tmp_path, form):
    df = rows(row("a\nb,\"c\"", 5, checksum_algorithm=["CRC32", "SHA1"], is_latest=True, version_id="v"), row("é"))
    df.write.format(form).save(str(tmp_path / form))
    back = inventory.read_inventory(spark, str(tmp_path / form), form)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_inventory_csv(spark, tmp_path):
    names = [f for f in "bucket entry_type key size last_modified e_tag storage_class checksum_algorithm checksum_type "
             "owner_display_name owner_id is_restore_in_progress restore_expiry_date version_id is_latest".split()]
    line = 'b,OBJECT,"a\nb, ""c""",5,2024-01-15T10:30:00Z,"""t""",,"CRC32,SHA1",,,,,,v,true'
    (tmp_path / "t.csv").write_text(",".join(names) + "\n" + line + "\n" + "b,OBJECT,é,0,2024-01-15T10:30:00Z,,,,,,,,,,\n")
    first, second = inventory.read_inventory(spark, str(tmp_path), "csv", line_breaks=True).collect()
    assert (first["key"], first["e_tag"], first["checksum_algorithm"]) == ('a\nb, "c"', '"t"', ["CRC32", "SHA1"])
    assert first["last_modified"] == DAY.replace(tzinfo=None) or first["last_modified"].timestamp() == DAY.timestamp()
    assert second["checksum_algorithm"] == [] and second["is_latest"] is None
    with pytest.raises(ValueError):
        inventory.read_inventory(spark, str(tmp_path), "xml")


def brute_targets(rows, wanted):
    pairs = {(b, p or "") for b, p in wanted if b is not None}
    return sorted((b, p, k, n) for b2, k, n in rows for b, p in pairs if b == b2 and k is not None and k.startswith(p))


def test_nested_targets_as_key_intervals(spark, monkeypatch):
    """Targets that hold each other, keys between them, buckets that begin alike, over many small ranges."""
    rng = random.Random(4)
    alphabet = ["a", "b", "/", "é", "\x00", "\U0001f600", "~"]
    word = lambda most: "".join(rng.choice(alphabet) for _ in range(rng.randrange(most)))
    names = ["x", "xa", "x/", "a", "é"]
    rows = [(rng.choice(names), word(9), n) for n in range(3000)] + [("x", "a/hot" + "a" * (n % 3), n) for n in range(500)]
    rows += [("x", None, 1), (None, "a", 2), ("zz", "", 3)]
    wanted = [(rng.choice(names), word(5)) for _ in range(400)] + [("x", "a/hot"), ("x", "a/hotaa"), ("x", None), ("zz", None), (None, "a"), ("none", "b")]
    df = spark.createDataFrame(rows, "bucket string, key string, n int")
    targets = spark.createDataFrame(wanted, "bucket string, prefix string")
    monkeypatch.setattr(ranges, "SAMPLES_PER_RANGE", 50)
    for per_partition in (1, 60):
        monkeypatch.setattr(target_source, "RANGES_PER_PARTITION", per_partition)
        found = under_targets(df, targets, broadcast_bytes=0)
        assert found.columns == ["bucket", "key", "n", "target_prefix"]
        assert sorted((r["bucket"], r["target_prefix"], r["key"], r["n"]) for r in found.collect()) == brute_targets(rows, wanted)


def test_wide_rows_are_shuffled_once_at_most(spark, rows):
    """With a hundred prefix lengths: no row is multiplied before an exchange, and few matches are broadcast."""
    df = rows(*[row("k" * n + "/x", bucket="b") for n in range(1, 120)])
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    targets = spark.createDataFrame([("b", "k" * n) for n in range(1, 101)], "bucket string, prefix string")
    many = under_targets(df, targets, broadcast_bytes=0)
    assert many.count() == sum(min(n, 100) for n in range(1, 120))
    above, below = plan(many).split("SortMergeJoin")
    assert "Generate explode" in above and "Exchange" not in above and "Generate" not in below
    targets = spark.createDataFrame([("b", "k" * 118 + "x" * n) for n in range(100)], "bucket string, prefix string")
    few = under_targets(df, targets, broadcast_bytes=5000)
    assert few.count() == 2 and "BroadcastHashJoin" in plan(few) and "SortMergeJoin" not in plan(few)
