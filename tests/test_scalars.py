import datetime as dt

import pytest
from conftest import UTC
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bucketscope.functions.keys import key_depth, prefix_at_depth, relative_key
from bucketscope.functions.scalars import escape_ctl, fmt_size, fmt_size_split, fmt_ts, parse_size


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, size",
    [
        ("0", 0), ("1", 1), ("1024", 1024), ("1KiB", 1024), ("1KB", 1000), ("8MiB", 8 << 20), ("5GiB", 5 << 30),
        ("10GiB", 10 << 30), ("50TiB", 50 << 40), ("1.5KiB", 1536), ("12B", 12), ("18446744073709551615", 2**64 - 1),
    ],
)
def test_parse_size(spark, text, size):
    assert parse_size(text) == size
    assert int(one(spark, parse_size(F.lit(text)))) == size


@pytest.mark.parametrize("text", ["524287a", "5Zib", "18446744073709551616", "", "-1", "KB", "99999999999999999999EiB"])
def test_parse_size_refuses(spark, text):
    with pytest.raises(ValueError):
        parse_size(text)
    assert one(spark, parse_size(F.lit(text))) is None


@pytest.mark.parametrize(
    "size, short, number, unit",
    [
        (0, "0", "0", "bytes"),
        (512, "512", "512", "bytes"),
        (1023, "1023", "1023", "bytes"),
        (1024, "1.0KiB", "1.0", "KiB"),
        (1280, "1.2KiB", "1.2", "KiB"),
        (1792, "1.8KiB", "1.8", "KiB"),
        (2048, "2.0KiB", "2.0", "KiB"),
        (1048575, "1024.0KiB", "1024.0", "KiB"),
        (1048576, "1.0MiB", "1.0", "MiB"),
        (5662310, "5.4MiB", "5.4", "MiB"),
        (50 << 40, "50.0TiB", "50.0", "TiB"),
        (2**62, "4.0EiB", "4.0", "EiB"),
    ],
)
def test_human_sizes(spark, size, short, number, unit):
    column = F.lit(size).cast("bigint")
    assert one(spark, fmt_size(column, human=True)) == short
    assert one(spark, fmt_size(column)) == str(size)
    assert tuple(one(spark, fmt_size_split(column))) == (number, unit)


@pytest.mark.parametrize(
    "zone, shown",
    [
        (None, "2024-01-15T10:30:00Z"),
        ("UTC", "2024-01-15T10:30:00+00:00"),
        ("Asia/Tokyo", "2024-01-15T19:30:00+09:00"),
        ("America/New_York", "2024-01-15T05:30:00-05:00"),
        ("-03:30", "2024-01-15T07:00:00-03:30"),
        ("-00:30", "2024-01-15T10:00:00-00:30"),
    ],
)
def test_timestamps(spark, zone, shown):
    at = F.lit(dt.datetime(2024, 1, 15, 10, 30, 0, 999999, tzinfo=UTC))
    assert one(spark, fmt_ts(at, zone)) == shown


def test_escape(spark):
    text = "a\tb\nc\x00\x1b\x7fé😀\\x"
    assert one(spark, escape_ctl(F.lit(text))) == "a\\x09b\\x0ac\\x00\\x1b\\x7fé😀\\x"
    assert one(spark, escape_ctl(F.lit(text), raw=True)) == text
    assert one(spark, escape_ctl(F.lit("plain"))) == "plain"


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=40, max_size=60))
def test_escape_agrees_with_a_plain_loop(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape_ctl(F.col("t")).alias("shown"))
    for r in df.collect():
        assert r["shown"] == "".join(f"\\x{ord(c):02x}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in r["t"])


@pytest.mark.parametrize(
    "key, depth",
    [
        ("p/file.txt", 1), ("p/a/file.txt", 2), ("p/a/b/file.txt", 3), ("p/sub/", 1), ("p/a/sub/", 2), ("p/", None),
        ("q/file.txt", None),
    ],
)
def test_key_depth(spark, key, depth):
    assert one(spark, key_depth(F.lit(key), "p/")) == depth


@pytest.mark.parametrize(
    "key, prefix, depth, boundary",
    [
        ("p/a/b/file.txt", "p/", 1, "p/a/"),
        ("p/a/b/file.txt", "p/", 2, "p/a/b/"),
        ("p/a/b/file.txt", "p/", 3, None),
        ("p/file.txt", "p/", 1, None),
        ("data-backup/x", "data", 1, "data-backup/"),
        ("q/a/b", "p/", 1, None),
        ("a//b", "", 2, "a//"),
    ],
)
def test_prefix_at_depth(spark, key, prefix, depth, boundary):
    assert one(spark, prefix_at_depth(F.lit(key), prefix, depth)) == boundary


@pytest.mark.parametrize(
    "key, prefix, shown",
    [
        ("logs/2024/a.log", "logs/", "2024/a.log"),
        ("logs/2024/a.log", "logs", "2024/a.log"),
        ("logs//report.csv", "logs/", "/report.csv"),
        ("logs//report.csv", "logs", "/report.csv"),
        ("logs/", "logs/", "logs/"),
        ("logs/", "logs", "logs/"),
        ("logs", "logs", "logs"),
        ("other/a", "logs/", "other/a"),
        ("logs/a", None, "logs/a"),
        ("logs-old/a", "logs", "-old/a"),
    ],
)
def test_relative_key(spark, key, prefix, shown):
    assert one(spark, relative_key(F.lit(key), prefix)) == shown
