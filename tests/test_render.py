import json

import pytest
from conftest import DAY, row, values
from pyspark.sql import functions as F

from bucketscope.operators.summary import summarize
from bucketscope.plans.display import Display, to_columns
from bucketscope.plans.render import (
    buckets_to_json,
    buckets_to_text,
    header,
    summary_json,
    summary_text,
    to_aligned,
    to_json,
    to_lines,
    to_tsv,
)
from bucketscope.plans.writer import read_lines, read_with_summary, write_buckets, write_listing, write_with_summary
from bucketscope.schema import BUCKET_SCHEMA
from bucketscope.sources.ndjson import read_listing_json, read_summary_json

DATE = "2024-01-15T10:30:00Z"
ALL = Display(
    storage_class=True, etag=True, checksum_algorithm=True, checksum_type=True, versions=True, is_latest=True,
    owner=True, restore_status=True,
)


def sample(rows):
    return rows(
        row("data/readme.txt", 1234, version_id="v1", is_latest=True, checksum_algorithm=["CRC32", "SHA256"],
            checksum_type="FULL_OBJECT", owner_display_name="o\tw", owner_id="1", is_restore_in_progress=False,
            restore_expiry_date="2025-01-01T00:00:00Z"),
        row("data/sub/", entry_type="PREFIX"),
        row("data/x\ny", entry_type="DELETE_MARKER", version_id="v2", is_latest=False, owner_id="2"),
    )


def test_tsv(rows):
    assert values(to_tsv(sample(rows))) == [
        f"{DATE}\t1234\tdata/readme.txt", "\tPRE\tdata/sub/", f"{DATE}\tDELETE\tdata/x\\x0ay",
    ]
    full = [v.split("\t") for v in values(to_tsv(sample(rows), ALL))]
    assert full[0] == [DATE, "1234", "STANDARD", "t", "CRC32,SHA256", "FULL_OBJECT", "v1", "LATEST", "o\\x09w", "1", "false",
                       "2025-01-01T00:00:00Z", "data/readme.txt"]
    assert full[1] == ["", "PRE", *[""] * 10, "data/sub/"]
    assert full[2] == [DATE, "DELETE", "", "", "", "", "v2", "NOT_LATEST", "", "2", "", "", "data/x\\x0ay"]


def test_aligned_pads_but_never_cuts(rows):
    lines = values(to_aligned(sample(rows), Display(human=True)))
    assert lines[0] == f"{DATE.ljust(25)}  {'1.2KiB'.rjust(9)}  data/readme.txt"
    assert lines[1] == f"{' ' * 25}  {'PRE'.rjust(9)}  data/sub/"
    long = rows(row("k", 1, version_id="v" * 40, is_latest=True), row("k", 1, version_id="é" * 30, is_latest=True))
    lines = values(to_aligned(long, Display(versions=True)))
    assert lines[0].endswith("v" * 40 + "  k")
    assert lines[1].endswith("é" * 30 + "    k")


def test_lines_and_relative_keys(rows):
    assert values(to_lines(sample(rows), Display(relative=True, prefix="data/"))) == ["readme.txt", "sub/", "x\\x0ay"]
    assert values(to_lines(sample(rows), Display(raw=True)))[2] == "data/x\ny"


def test_json(rows):
    stored, prefix, marker = [json.loads(v) for v in values(to_json(sample(rows), ALL))]
    assert stored == {
        "Key": "data/readme.txt", "LastModified": DATE, "ETag": '"t"', "ChecksumAlgorithm": ["CRC32", "SHA256"],
        "ChecksumType": "FULL_OBJECT", "Size": 1234, "VersionId": "v1", "IsLatest": True,
        "Owner": {"DisplayName": "o\tw", "ID": "1"},
        "RestoreStatus": {"IsRestoreInProgress": False, "RestoreExpiryDate": "2025-01-01T00:00:00Z"},
    }
    assert prefix == {"Prefix": "data/sub/"}
    assert marker == {
        "Key": "data/x\ny", "VersionId": "v2", "IsLatest": False, "LastModified": DATE, "DeleteMarker": True,
        "Owner": {"ID": "2"},
    }
    plain = json.loads(values(to_json(rows(row("k", 1, e_tag=None, storage_class="GLACIER"))))[0])
    assert plain == {"Key": "k", "LastModified": DATE, "ETag": "", "Size": 1, "StorageClass": "GLACIER"}


def test_summaries(rows):
    stats = summarize(sample(rows))
    assert values(summary_text(stats, "tsv")) == ["\nTotal:\t1\tobjects\t1234\tbytes"]
    assert values(summary_text(stats, "aligned", Display(human=True, versions=True))) == [
        "\nTotal: 1 objects 1.2 KiB 1 delete markers"
    ]
    assert json.loads(values(summary_json(stats))[0]) == {"Summary": {"TotalObjects": 1, "TotalSize": 1234}}
    assert json.loads(values(summary_json(stats, versions=True))[0])["Summary"]["TotalDeleteMarkers"] == 1


def test_headers(spark):
    assert header("tsv") == "DATE\tSIZE\tKEY"
    assert header("tsv", ALL).split("\t") == [
        "DATE", "SIZE", "STORAGE_CLASS", "ETAG", "CHECKSUM_ALGORITHM", "CHECKSUM_TYPE", "VERSION_ID", "IS_LATEST",
        "OWNER_DISPLAY_NAME", "OWNER_ID", "IS_RESTORE_IN_PROGRESS", "RESTORE_EXPIRY_DATE", "KEY",
    ]
    assert header("aligned") == "DATE".ljust(25) + "  " + "SIZE".ljust(14) + "  KEY"
    assert header("lines") == "KEY" and header("lines", buckets=True) == "BUCKET" and header("json") is None
    assert header("tsv", Display(bucket_arn=True), buckets=True) == "DATE\tREGION\tBUCKET\tBUCKET_ARN"


def test_columns_keep_their_order(rows):
    assert to_columns(sample(rows), ALL).columns == header("tsv", ALL).split("\t")


def test_buckets(spark):
    df = spark.createDataFrame([("b\x1b1", DAY, None, "arn", None, "7"), ("c", None, "eu", None, None, None)], BUCKET_SCHEMA)
    assert values(buckets_to_text(df, "tsv", Display(owner=True))) == [f"{DATE}\t\tb\\x1b1\t\t7", "\teu\tc\t\t"]
    assert values(buckets_to_text(df, "aligned"))[1] == " " * 25 + "  " + "eu".ljust(20) + "  c"
    assert values(buckets_to_text(df, "lines")) == ["b\\x1b1", "c"]
    shown = [json.loads(v) for v in values(buckets_to_json(df, show_owner=True))]
    assert shown == [
        {"Name": "b\x1b1", "CreationDate": DATE, "BucketArn": "arn", "Owner": {"ID": "7"}}, {"Name": "c", "BucketRegion": "eu"},
    ]
    assert "Owner" not in json.loads(values(buckets_to_json(df))[0])
    with pytest.raises(ValueError):
        buckets_to_text(df, "html")


def written(path) -> list[str]:
    parts = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
    return "".join(p.read_text() for p in parts).split("\n")


def test_written_lines_are_in_order_across_files(spark, rows, tmp_path):
    df = spark.range(500).selectExpr("id", "format_string('k%04d', id * 37 % 500) as key")
    base = rows(row("x", 3)).drop("key").crossJoin(df.select("key"))
    write_listing(base, str(tmp_path / "out"), "lines", with_header=True, summary=True)
    lines = written(tmp_path / "out")
    assert lines == ["KEY", *[f"k{n:04d}" for n in range(500)], "", "Total: 500 objects 1500 bytes", ""]
    write_listing(base, str(tmp_path / "back"), "lines", reverse=True)
    assert written(tmp_path / "back")[:-1] == [f"k{n:04d}" for n in reversed(range(500))]
    write_listing(base, str(tmp_path / "any"), "lines", sort=None, with_header=True, summary=True)
    lines = written(tmp_path / "any")
    assert lines[0] == "KEY" and lines[-2].startswith("Total:") and len(lines) == 504


def test_the_total_is_counted_as_the_rows_are_written(spark, rows, tmp_path, monkeypatch):
    """One evaluation of the input without a sort; with one, none beside that which samples its ranges."""
    seen = spark.sparkContext.accumulator(0)
    base = rows(*[row(f"k{n}", n) for n in range(50)], row("m", entry_type="DELETE_MARKER"), row("p/", entry_type="PREFIX"))

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = base.mapInArrow(count, base.schema)
    write_listing(watched, str(tmp_path / "any"), "tsv", Display(versions=True), sort=None, summary=True)
    assert seen.value == 52
    assert written(tmp_path / "any")[-2] == "Total:\t50\tobjects\t1225\tbytes\t1\tdelete markers"
    write_with_summary(watched, str(tmp_path / "typed"))
    assert seen.value == 104
    back = read_with_summary(spark, str(tmp_path / "typed"))
    assert sorted(map(str, back.where("section = 0").select(base.columns).collect())) == sorted(map(str, base.collect()))
    total = back.where("section = 1").first()
    assert (total["total_objects"], total["total_size"], total["total_delete_markers"], total["key"]) == (50, 1225, 1, None)
    write_listing(watched, str(tmp_path / "sorted"), "lines", summary=True)
    assert seen.value <= 104 + 2 * 52
    assert written(tmp_path / "sorted")[-2] == "Total: 50 objects 1225 bytes"


def test_a_failed_write_leaves_no_listing(spark, rows, tmp_path):
    base = rows(*[row(f"k{n}", n) for n in range(20)])
    broken = base.withColumn("key", F.when(F.col("size") == 13, F.raise_error(F.lit("no"))).otherwise(F.col("key")))
    for write in (lambda p: write_listing(broken, p, "tsv", sort=None, summary=True), lambda p: write_with_summary(broken, p)):
        with pytest.raises(Exception, match="no"):
            write(str(tmp_path / "out"))
        assert list(tmp_path.iterdir()) == []
    write_listing(base, str(tmp_path / "out"), "lines")
    with pytest.raises(ValueError, match="already exists"):
        write_listing(base, str(tmp_path / "out"), "lines")
    write_listing(base.where("size > 9"), str(tmp_path / "out"), "lines", mode="ignore")
    assert len(written(tmp_path / "out")) == 21
    write_listing(base.where("size > 9"), str(tmp_path / "out"), "lines", mode="overwrite")
    assert len(written(tmp_path / "out")) == 11
    with pytest.raises(ValueError, match="mode"):
        write_listing(base, str(tmp_path / "out"), "lines", mode="append")
    # a failed overwrite keeps what was there
    with pytest.raises(Exception, match="no"):
        write_listing(broken, str(tmp_path / "out"), "lines", mode="overwrite")
    assert len(written(tmp_path / "out")) == 11 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_lines_are_read_with_their_places(spark, rows, tmp_path):
    base = rows(*[row(f"k{n:03d}", n) for n in range(300)])
    write_listing(base.repartition(7), str(tmp_path / "out"), "lines", with_header=True, summary=True)
    found = [r["value"] for r in read_lines(spark, str(tmp_path / "out")).orderBy("pos").collect()]
    assert found == ["KEY", *[f"k{n:03d}" for n in range(300)], "", "Total: 300 objects 44850 bytes"]
    write_listing(base.limit(0), str(tmp_path / "none"), "lines", with_header=True, summary=True)
    assert [r["value"] for r in read_lines(spark, str(tmp_path / "none")).orderBy("pos").collect()] == ["KEY", "", "Total: 0 objects 0 bytes"]


def test_bucket_listings_are_written_in_one_call(spark, tmp_path):
    buckets = spark.createDataFrame([("b", None, "eu", None, "o", "1"), ("a", DAY, "us", "arn", None, None)], BUCKET_SCHEMA)
    write_buckets(buckets, str(tmp_path / "t"), "tsv", sort=["date"], with_header=True)
    assert written(tmp_path / "t") == ["DATE\tREGION\tBUCKET", "\teu\tb", "2024-01-15T10:30:00Z\tus\ta", ""]
    write_buckets(buckets, str(tmp_path / "l"), "lines", reverse=True)
    assert written(tmp_path / "l") == ["b", "a", ""]


def test_parquet_and_json_round_trip(spark, rows, tmp_path):
    df = sample(rows)
    write_listing(df, str(tmp_path / "table"), "parquet")
    assert spark.read.parquet(str(tmp_path / "table")).exceptAll(df).count() == 0
    write_listing(df, str(tmp_path / "json"), "json", Display(versions=True), summary=True)
    back = read_listing_json(spark, str(tmp_path / "json"), bucket="b")
    wanted = df.withColumn("e_tag", F.coalesce("e_tag", F.lit(""))).withColumn(
        "checksum_algorithm", F.when(F.col("entry_type") == "OBJECT", F.col("checksum_algorithm"))
    ).withColumn("e_tag", F.when(F.col("entry_type") == "OBJECT", F.col("e_tag")).otherwise(""))
    assert sorted(map(str, back.collect())) == sorted(map(str, wanted.collect()))
    assert tuple(read_summary_json(spark, str(tmp_path / "json")).first()) == (1, 1234, 1)


def test_a_compressed_listing_reads_as_the_plain_one(spark, rows, tmp_path):
    listed = rows(*[row(f"k{i:04d}", i) for i in range(500)]).repartition(3)
    read = {}
    for name, packed in (("plain", None), ("packed", "gzip")):
        write_listing(listed, str(tmp_path / name), "tsv", with_header=True, summary=True, compression=packed)
        read[name] = [r["value"] for r in read_lines(spark, str(tmp_path / name)).orderBy("pos").collect()]
    assert read["packed"] == read["plain"] and len(read["plain"]) == 503
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).glob("part-0*"))
    assert 0 < 3 * size("packed") < size("plain")
