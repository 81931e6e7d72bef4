"""Archives: exact round trips, revisits against brute force, rolled files, commits."""

import base64
import glob
import gzip
import hashlib
import io
import os
import random

import pytest

from bucketscope.llm import warc
from bucketscope.session import scratch

SCHEMA = "page_id long, url string, html string, place int, digest string, shard string"


def pages(n=200, seed=2):
    rng = random.Random(seed)
    texts = ["", None, "same", "ü" * 3, "a\r\n\r\nWARC/1.1\r\nb", "<p>\x00</p>", "x" * 200_000]
    rows = [(i, f"https://example.org/{i}", rng.choice([*texts, f"page {rng.randrange(60)}"])) for i in range(n)]
    rows += [(n, None, "no address"), (n + 1, "http://a\nb\tc", "odd address"), (None, "u", "same"), (None, "u", "only here")]
    rows += [(5, "again", "same"), (n + 2, "twice", "twice"), (n + 2, "twice", "twice")]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", "s") for r in rows], SCHEMA)


def brute(rows, least=0):
    first = {}
    for i, _, html in rows:
        key = html or ""
        if i is not None and len(key.encode()) >= least:
            first[key] = min(first.get(key, i), i)
    out, begun = [], set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        again = len(raw) >= least and (html or "") in begun
        begun.add(html or "")
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if again else "response", first.get(html or "") if again else None))
    return sorted(out, key=str)


def digests(df):
    number = lambda v: None if v is None else int(v)
    return sorted(((number(r["source_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in df.collect()), key=str)


def files(path):
    root = path.removeprefix("file:")
    return sorted(glob.glob(f"{root}/*.warc.gz")), root


@pytest.mark.parametrize("hot_rows, least", [(1000, 0), (5, 0), (5, 5)])
def test_round_trip(spark, monkeypatch, hot_rows, least):
    monkeypatch.setattr(warc, "HOT_ROWS", hot_rows)
    rows = pages()
    path = scratch(spark, "archive")
    manifest = warc.write_archives(table(spark, rows).repartition(3), path, shard_bytes=300_000, file_bytes=4000, least_bytes=least)
    found = warc.read_archives(spark, path)
    assert digests(found) == brute(rows, least)
    got = found.collect()
    texts = {(r["source_id"], r["url"]): r["payload"].decode() for r in got if r["record_type"] == "response"}
    assert all(t == "" or t in {h for _, _, h in rows} for t in texts.values())
    assert {t for t in texts.values()} == {h or "" for _, _, h in rows}
    ids = [r["record_id"] for r in got]
    assert len(set(ids)) == len(ids) == len(rows)
    listed = manifest.collect()
    assert sum(r["records"] for r in listed) == len(rows)
    names, root = files(path)
    assert [os.path.basename(n) for n in names] == sorted(r["name"] for r in listed)
    assert not os.path.exists(f"{root}/temporary")
    # files are rolled by compressed size: one that is larger holds a single record
    assert len({r["part"] for r in listed}) > 1
    assert all(r["bytes"] <= 4000 or r["records"] == 1 for r in listed)
    assert all(warc.read_archives(spark, path, payloads=False).select("payload").distinct().first()[0] is None for _ in (1,))


def test_records_have_the_fields_of_the_format(spark):
    path = scratch(spark, "archive")
    rows = [(1, "http://a\nb", "text"), (2, "http://c", "text"), (3, None, None)]
    warc.write_archives(table(spark, rows), path)
    found = {}
    for name in files(path)[0]:
        raw = open(name, "rb").read()
        for fields, block in warc.parse_records(io.BytesIO(gzip.decompress(raw))):
            found[fields["source-id"]] = fields, block
    fields, block = found["1"]
    assert fields["warc-target-uri"] == "http://a%0Ab" and fields["warc-type"] == "response"
    assert block.endswith(b"\r\n\r\ntext") and block.startswith(b"HTTP/1.1 200 OK\r\n")
    assert fields["warc-block-digest"] == f"sha1:{warc.sha1(block)}" and fields["warc-payload-digest"] == f"sha1:{warc.sha1(b'text')}"
    again, empty = found["2"][0], found["3"][0]
    assert again["warc-refers-to"] == fields["warc-record-id"] and again["refers-to-source-id"] == "1" and "warc-profile" in again
    assert "warc-target-uri" not in empty and empty["payload-length"] == "0"


def test_the_same_rows_give_the_same_bytes(spark):
    rows = pages(120)
    made = []
    for parts in (2, 5):
        path = scratch(spark, "archive")
        warc.write_archives(table(spark, rows).repartition(parts), path, shard_bytes=100_000, file_bytes=3000)
        made.append({os.path.basename(n): open(n, "rb").read() for n in files(path)[0]})
    assert made[0] == made[1] and len(made[0]) > 3


def test_what_is_not_whole_is_refused(spark):
    rows = pages(40)
    path = scratch(spark, "archive")
    warc.write_archives(table(spark, rows), path)
    with pytest.raises(ValueError, match="already holds"):
        warc.write_archives(table(spark, rows), path)
    with pytest.raises(ValueError, match="no complete"):
        warc.read_archives(spark, scratch(spark, "nothing"))
    name = files(path)[0][0]
    whole = open(name, "rb").read()
    with open(name, "wb") as out:
        out.write(whole[:-1])
    with pytest.raises(Exception, match="not the file"):
        warc.read_archives(spark, path).collect()
    records = list(warc.parse_records(io.BytesIO(gzip.decompress(whole))))
    fields, block = records[0]
    with pytest.raises(ValueError, match="digest"):
        warc._row("f", 0, fields, block + b"x", True)


def test_a_file_that_was_renamed_before_is_no_fault(spark):
    """A rename job that runs again, after one that was cut, finds the files under their names."""
    path = scratch(spark, "archive")
    manifest = warc.write_archives(table(spark, pages(30)), path)
    root = files(path)[1]
    rows = [(r["shard"], r["part"], "temporary/gone", r["name"], r["records"], r["bytes"], r["sha1"]) for r in manifest.collect()]
    os.rename(f"{root}/{warc.MANIFEST}", f"{root}/before")
    os.mkdir(f"{root}/temporary")
    again = warc.commit(spark, path, spark.createDataFrame(rows, warc.MANIFEST_SCHEMA))
    assert again.count() == len(rows)
    os.rename(f"{root}/{warc.MANIFEST}", f"{root}/second")
    lost = [(*rows[0][:3], "records-lost.warc.gz", *rows[0][4:])]
    with pytest.raises(Exception):
        warc.commit(spark, path, spark.createDataFrame(lost, warc.MANIFEST_SCHEMA))
    with pytest.raises(ValueError):
        warc.read_archives(spark, path)


def test_empty_table(spark):
    path = scratch(spark, "archive")
    warc.write_archives(table(spark, pages(3)).limit(0), path)
    assert warc.read_archives(spark, path).collect() == []
