"""WARC archives written in deterministic shards, and read back (operator 12).

Records are dealt to shards by ranges of their payload's SHA-256, whose values are even, so the ranges follow from the
amount of data alone, and are sorted by it within a shard: records of equal payload are neighbours, the first is the
response and the others revisit it. One exchange moves the payloads. A payload with very many records would make one
shard large; those of its records that revisit it lose their payload before the exchange and are spread over all shards.

A task writes a shard as files that it rolls by compressed size, a gzip member per record, under a name of its own
attempt, and returns one manifest row per file. Spark keeps the rows of one attempt per task only. The files they name are
then renamed, and the manifest is written last: what it does not name is no part of the archive, and without it there is
none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.llm.common import HOT_SHARE, in_python, stored

#: Compressed bytes from which the next record begins a new file.
FILE_BYTES = 256 << 20
#: Payload bytes of a shard: the larger one, but few shards are made smaller so that there is work for all.
SHARD_BYTES = 1 << 30
LEAST_SHARD_BYTES = 8 << 20
FEW_SHARDS = 64
#: Records of one payload from which those that revisit it are spread, at least.
HOT_ROWS = 1000
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
#: Payload bytes or records of a batch that the reader puts out.
BATCH_BYTES = 8 << 20
BATCH_RECORDS = 4096
MANIFEST = "manifest"
#: Files are listed and renamed by at most so many tasks.
MAX_TASKS = 10_000

# fixed values: names of the format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"
HTTP_TYPE = "application/http; msgtype=response"
# fields of our own, which readers that do not know them pass over
ID_FIELD, LENGTH_FIELD, REFERS_FIELD = "Source-Id", "Payload-Length", "Refers-To-Source-Id"

MANIFEST_SCHEMA = "shard int, part int, temporary string, name string, records long, bytes long, sha1 string"
RECORD_SCHEMA = (
    "file string, place long, record_id string, record_type string, source_id string, url string, "
    "payload binary, payload_bytes long, payload_digest string, refers_to string"
)
_RECORDS = pa.schema([
    ("file", pa.string()), ("place", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
    ("source_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.string()),
])


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def sha1(block: bytes) -> str:
    return base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(str, parts)))}>"


def _one_line(value: str) -> str:
    """A field's value without characters that would end it, percent-encoded as in addresses."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """One record; fields without a value are left out."""
    fields |= {"WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Length": str(len(block))}
    lines = [VERSION, *(f"{k}: {_one_line(v)}".encode() for k, v in fields.items() if v is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def http_block(length: int, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    return head.encode() + payload


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that all machines reach, and the path there."""
    return fs.FileSystem.from_uri(path)


class _Roll:
    """Files of one shard, one after the other; a manifest row for each."""

    def __init__(self, path: str, attempt: str, shard: int, file_bytes: int):
        self.system, root = filesystem(path)
        self.root, self.attempt, self.shard, self.limit = root.rstrip("/"), attempt, shard, file_bytes
        self.part, self.out, self.rows = 0, None, []

    def add(self, data: bytes) -> None:
        # no time of day in the member, so that the same record gives the same bytes
        member = gzip.compress(data, LEVEL, mtime=0)
        if self.out is not None and self.written + len(member) > self.limit:
            self.close()
        if self.out is None:
            self.temporary = f"temporary/{self.attempt}-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.out = self.system.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.records, self.written, self.digest = 0, 0, hashlib.sha1()
        self.out.write(member)
        self.digest.update(member)
        self.records += 1
        self.written += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"records-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.rows.append((self.shard, self.part, self.temporary, name, self.records, self.written, self.digest.hexdigest()))
            self.out, self.part = None, self.part + 1


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = batch.columns
        for at in range(batch.num_rows):
            yield tuple(column[at].as_py() for column in columns)


def write_archives(
    pages: DataFrame,
    path: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    file_bytes: int = FILE_BYTES,
    shard_bytes: int = SHARD_BYTES,
    least_bytes: int = 0,
    date: str = DATE,
) -> DataFrame:
    """Write a record per row below ``path``, which must hold no archive yet, and return the manifest.

    Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest identifier (a null one
    last; of rows that repeat it, one) is the response and the others revisit it, without their payload. The payload is
    the column's UTF-8 bytes, a null one empty; a null address leaves its field out. Control characters in an address are
    percent-encoded. Rows that repeat are records of their own. Other columns are not read. An empty table gives an archive
    without files. A payload is held in memory whole, as Spark holds it.

    The same rows give the same shards; files hold them in the same order and are the same bytes, except that records of
    a payload with more than a ten-thousandth of all rows, and payloads too short to be compared, are spread by their place
    in the input.
    """
    spark = pages.sparkSession
    system, root = filesystem(path)
    if system.get_file_info(f"{root.rstrip('/')}/{MANIFEST}").type != fs.FileType.NotFound:
        raise ValueError(f"{path} already holds an archive")
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"").cast("binary"))
    # stored, so that a row's place in the input is the same in every pass over the rows
    rows = stored(
        pages.select(
            F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"),
            F.sha2(payload, 256).alias("digest"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("length"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "records",
        "zstd",
    )
    total, volume = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    shards = max(-(-volume // shard_bytes), min(FEW_SHARDS, -(-volume // min(shard_bytes, LEAST_SHARD_BYTES))), 1)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "place")
    equal = rows.where(F.col("length") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first"))
    # each holds at least one in HOT_SHARE of all rows, so there are at most HOT_SHARE of them
    hot = equal.where(F.col("copies") >= max(HOT_ROWS, total // HOT_SHARE + 1)).select("digest", "first")
    joined = rows.join(F.broadcast(hot), "digest", "left")
    away = F.col("first").isNotNull() & (F.col("first.place") != F.col("place"))
    alone = F.col("length") < least_bytes
    # the first 32 bits of the digest, cut into equal ranges
    home = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * shards / F.lit(1 << 32))
    dealt = joined.select(
        F.when(away | alone, F.pmod(F.xxhash64("digest", "place"), F.lit(shards))).otherwise(home).cast("int").alias("shard"),
        "digest", F.col("id").cast("string").alias("source_id"), "url", "sha1", "length", away.alias("away"),
        F.when(~away, F.col("payload")).alias("payload"), F.col("first.id").cast("string").alias("first_id"), "id", "place",
    )
    ordered = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "digest", "away", F.col("id").asc_nulls_last(), "place")
    ordered = ordered.drop("id", "place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, out, run, files = uuid.uuid4().hex, None, None, []
        for shard, digest, source_id, url, sha1_hex, length, away, payload, first_id in _rows_of(batches):
            if out is None or out.shard != shard:
                if out is not None:
                    out.close()
                    files += out.rows
                out, run = _Roll(path, attempt, shard, file_bytes), None
            fields = {
                "WARC-Type": "response",
                "WARC-Record-ID": record_id(digest),
                "WARC-Date": date,
                "WARC-Target-URI": url,
                "WARC-Payload-Digest": f"sha1:{base32(sha1_hex)}",
                "Content-Type": HTTP_TYPE,
                ID_FIELD: source_id,
                LENGTH_FIELD: str(length),
            }
            if run is None or run[0] != digest:
                run = [digest, source_id, 0]
                first = not away
            else:
                first = False
            if length < least_bytes:
                # all are responses: told apart by their identifier and number in the shard
                fields["WARC-Record-ID"] = record_id(digest, shard, run[2], source_id)
                out.add(record(fields, http_block(length, payload)))
            elif first:
                out.add(record(fields, http_block(length, payload)))
            else:
                refers = first_id if away else run[1]
                fields |= {
                    "WARC-Type": "revisit", "WARC-Record-ID": record_id(digest, shard, run[2], source_id, "revisit"),
                    "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(digest), REFERS_FIELD: refers,
                }
                out.add(record(fields, http_block(length, b"")))
            run[2] += 1
        if out is not None:
            out.close()
            files += out.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[n] for f in files], kind) for n, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
            names=["shard", "part", "temporary", "name", "records", "bytes", "sha1"],
        )

    system.create_dir(f"{root.rstrip('/')}/temporary", recursive=True)
    manifest = stored(in_python(ordered).mapInArrow(write, MANIFEST_SCHEMA), "manifest")
    return commit(spark, path, manifest)


def commit(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Give the files of the manifest their names, then write it: from then on the archive exists. Can be repeated."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(path)
        root = root.rstrip("/")
        for batch in batches:
            for temporary, name, size in zip(*[batch.column(c).to_pylist() for c in ("temporary", "name", "bytes")]):
                try:
                    system.move(f"{root}/{temporary}", f"{root}/{name}")
                except OSError:
                    # an attempt before this one may have done it
                    if system.get_file_info(f"{root}/{name}").size != size:
                        raise
            yield batch

    by_file = _by_file(manifest)
    in_python(by_file).mapInArrow(rename, manifest.schema).drop("temporary").write.parquet(f"{path.rstrip('/')}/{MANIFEST}")
    system, root = filesystem(path)
    system.delete_dir(f"{root.rstrip('/')}/temporary")
    return read_manifest(spark, path)


def _by_file(manifest: DataFrame) -> DataFrame:
    files = manifest.count()
    return manifest.repartitionByRange(max(1, min(files, MAX_TASKS)), "name")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    system, root = filesystem(path)
    if system.get_file_info(f"{root.rstrip('/')}/{MANIFEST}/_SUCCESS").type == fs.FileType.NotFound:
        raise ValueError(f"{path} holds no complete archive")
    kinds = ", ".join(part for part in MANIFEST_SCHEMA.split(", ") if not part.startswith("temporary"))
    return spark.read.schema(kinds).parquet(f"{path.rstrip('/')}/{MANIFEST}")


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an uncompressed stream."""
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield fields, block


def payload_of(block: bytes) -> bytes:
    """What follows the head of an HTTP message."""
    return block[block.index(b"\r\n\r\n") + 4 :]


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of a complete archive (``RECORD_SCHEMA``), each file read by one task as a stream.

    Digests of blocks and payloads, file sizes and record counts are checked against fields and manifest, and raise where
    they differ. Payloads are null for revisits, and for all with ``payloads=False``.
    """
    manifest = read_manifest(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(path)
        for batch in batches:
            for name, records, size in zip(*[batch.column(c).to_pylist() for c in ("name", "records", "bytes")]):
                where = f"{root.rstrip('/')}/{name}"
                if system.get_file_info(where).size != size:
                    raise ValueError(f"{name} is not the file of the manifest")
                rows, held, place = [], 0, 0
                with system.open_input_stream(where, compression=None) as raw, gzip.GzipFile(fileobj=raw) as members:
                    for fields, block in parse_records(io.BufferedReader(members, 1 << 20)):
                        row = _row(name, place, fields, block, payloads)
                        rows.append(row)
                        held += len(row[6] or b"")
                        place += 1
                        if held >= BATCH_BYTES or len(rows) == BATCH_RECORDS:
                            yield _batch(rows)
                            rows, held = [], 0
                if place != records:
                    raise ValueError(f"{name} has {place} records, not {records}")
                if rows:
                    yield _batch(rows)

    return in_python(_by_file(manifest)).mapInArrow(read, RECORD_SCHEMA)


def _row(name: str, place: int, fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    payload = payload_of(block) if kind == "response" else None
    if fields["warc-block-digest"] != f"sha1:{sha1(block)}" or (payload is not None and sha1(payload) != digest):
        raise ValueError(f"{name}: the digest of record {place} is wrong")
    length = int(fields[LENGTH_FIELD.lower()]) if payload is None else len(payload)
    return (
        name, place, fields["warc-record-id"], kind, fields.get(ID_FIELD.lower()), fields.get("warc-target-uri"),
        payload if payloads else None, length, digest, fields.get(REFERS_FIELD.lower()),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)
