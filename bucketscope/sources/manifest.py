"""A file-level index of a stored inventory: which files can hold what a listing asks for.

The index lies beside the files (``_manifest``, a name that scans pass over) with a row per file: the ranges of its keys,
sizes and dates, and of its buckets, kinds and storage classes. It is made from footers, read by tasks. A listing then opens
the files that can match and no others. Files that the index does not know, or knows with another length, are always read,
so an index that is behind costs time and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.operators.filters import FilterConfig, apply_filters
from bucketscope.operators.hierarchy import write_inventory
from bucketscope.schema import DELETE_MARKER, LISTING_SCHEMA, PREFIX
from bucketscope.session import ship_package
from bucketscope.sources.layout import FILES_PER_TASK, data_files
from bucketscope.sources.targets import under

FOLDER = "_manifest"
#: Columns whose ranges are kept, with their Spark and Arrow types.
RANGED = {
    "bucket": ("string", pa.string()),
    "entry_type": ("string", pa.string()),
    "key": ("string", pa.string()),
    "size": ("bigint", pa.int64()),
    "last_modified": ("timestamp", pa.timestamp("us", "UTC")),
    "storage_class": ("string", pa.string()),
}
_FIELDS = [pa.field("file", pa.string()), pa.field("length", pa.int64()), pa.field("rows", pa.int64())]
for _name, (_, _kind) in RANGED.items():
    _FIELDS += [pa.field(f"least_{_name}", _kind), pa.field(f"most_{_name}", _kind), pa.field(f"nulls_{_name}", pa.int64())]
_ARROW_SCHEMA = pa.schema(_FIELDS)
MANIFEST_SCHEMA = "file string, length bigint, rows bigint, " + ", ".join(
    f"least_{name} {kind}, most_{name} {kind}, nulls_{name} bigint" for name, (kind, _) in RANGED.items()
)


def file_ranges(file: str, length: int) -> dict[str, object]:
    """A row of the index from a file's footer. A range is null where the footer does not give it for all row groups."""
    system, place = fs.FileSystem.from_uri(file)
    with system.open_input_file(place) as opened:
        footer = pq.ParquetFile(opened).metadata
    row: dict[str, object] = {"file": file, "length": length, "rows": footer.num_rows}
    columns = {footer.schema.column(n).path: n for n in range(footer.num_columns)}
    for name in RANGED:
        found = [footer.row_group(g).column(columns[name]).statistics for g in range(footer.num_row_groups)] if name in columns else [None]
        counted = all(s is not None and s.has_null_count for s in found)
        row[f"nulls_{name}"] = sum(s.null_count for s in found) if counted else None
        # a row group of nulls only has no range and needs none
        ranged = [s for s, g in zip(found, range(footer.num_row_groups)) if not (counted and s.null_count == footer.row_group(g).num_rows)]
        # the older form of dates has no order, so no range either
        known = ranged and all(s is not None and s.has_min_max and s.physical_type != "INT96" for s in ranged)
        row[f"least_{name}"] = min(s.min for s in ranged) if known else None
        row[f"most_{name}"] = max(s.max for s in ranged) if known else None
    return row


def _place(path: str) -> str:
    return f"{path.rstrip('/')}/{FOLDER}"


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The index of the inventory at ``path``, or None where it has none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_place(path))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(MANIFEST_SCHEMA).parquet(_place(path)) if system.exists(folder) else None


def _unknown(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    return files if manifest is None else files.join(manifest.select("file", "length"), ["file", "length"], "left_anti")


def write_manifest(spark: SparkSession, path: str) -> None:
    """Add the Parquet files of an inventory that its index does not know yet. Where Arrow does not know the file system,
    nothing is written, and listings read every file."""
    ship_package(spark)
    new = _unknown(data_files(spark, path), read_manifest(spark, path))
    files, example = new.agg(F.count(F.lit(1)), F.min("file")).first()
    if not files:
        return
    try:
        fs.FileSystem.from_uri(example)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [file_ranges(*row) for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_SCHEMA)

    dealt = new.repartition(-(-files // FILES_PER_TASK))
    dealt.mapInArrow(read, MANIFEST_SCHEMA).write.mode("append").parquet(_place(path))


def store_inventory(
    df: DataFrame, path: str, n: int | None = None, mode: str = "errorifexists", mark_latest: bool = False
) -> None:
    """Store an inventory in key order with its index, so that listings open only the files that can match; see
    :func:`~bucketscope.operators.hierarchy.write_inventory`."""
    write_inventory(df, path, n, mode, mark_latest)
    write_manifest(df.sparkSession, path)


def _after(name: str, value: Column) -> Column:
    """Whether a file can hold values of at least ``value``; one without a range can."""
    return F.coalesce(F.col(f"most_{name}") >= value, F.lit(True))


def _before(name: str, value: Column, strictly: bool = False) -> Column:
    least = F.col(f"least_{name}")
    return F.coalesce(least < value if strictly else least <= value, F.lit(True))


def may_match(bucket: str | None, prefix: str | None, filters: FilterConfig) -> Column:
    """Whether a file of the index can hold a row of a bucket and prefix that passes the filters.

    The filters are those of :meth:`FilterConfig.predicate`: directories pass all, delete markers those about stored bytes.
    Patterns decide by the text that their matches begin with.
    """
    held = F.lit(True)
    if bucket is not None:
        held = held & _after("bucket", F.lit(bucket)) & _before("bucket", F.lit(bucket))
    for head in (prefix, filters.key_head()):
        if head:
            begins = F.col("least_key").startswith(head)
            inside = _after("key", F.lit(head)) & (_before("key", F.lit(head)) | F.coalesce(begins, F.lit(True)))
            held = held & (inside if head == prefix else _kind(PREFIX) | inside)
    dated, stored = F.lit(True), F.lit(True)
    if filters.mtime_before is not None:
        dated = dated & _before("last_modified", filters.instant(filters.mtime_before), strictly=True)
    if filters.mtime_after is not None:
        dated = dated & _after("last_modified", filters.instant(filters.mtime_after))
    if filters.smaller_size is not None:
        stored = stored & _before("size", filters.size_value(filters.smaller_size), strictly=True)
    if filters.larger_size is not None:
        stored = stored & _after("size", filters.size_value(filters.larger_size))
    if filters.storage_class is not None:
        classes = [_after("storage_class", F.lit(c)) & _before("storage_class", F.lit(c)) for c in filters.storage_class]
        if "STANDARD" in filters.storage_class:
            classes.append(F.coalesce(F.col("nulls_storage_class") > 0, F.lit(True)))
        some = F.lit(False)
        for one in classes:
            some = some | one
        stored = stored & some
    return held & (_kind(PREFIX) | (dated & (_kind(DELETE_MARKER) | stored)))


def _kind(kind: str) -> Column:
    """Whether a file can hold rows of a kind; the two asked for are the first and the last by name."""
    edge = F.col("most_entry_type" if kind == PREFIX else "least_entry_type")
    return F.coalesce(edge == kind, F.lit(True))


def choose_files(
    spark: SparkSession, path: str, bucket: str | None = None, prefix: str | None = None, filters: FilterConfig = FilterConfig()
) -> list[str]:
    """The files that a listing must open. Only their names come to the driver."""
    files, manifest = data_files(spark, path), read_manifest(spark, path)
    if manifest is None:
        return sorted(r["file"] for r in files.select("file").collect())
    known = manifest.withColumn("matches", may_match(bucket, prefix, filters)).select("file", "length", "matches")
    wanted = files.join(known, ["file", "length"], "left").where(F.coalesce("matches", F.lit(True)))
    return sorted(r["file"] for r in wanted.select("file").distinct().collect())


def scan(
    spark: SparkSession, path: str, bucket: str | None = None, prefix: str | None = None, filters: FilterConfig = FilterConfig()
) -> DataFrame:
    """Rows of a stored inventory of one bucket (or all) under a prefix that pass the filters, from the files that can hold
    such rows. Within these, the conditions reach the scan as ever."""
    files = choose_files(spark, path, bucket, prefix, filters)
    rows = spark.read.schema(LISTING_SCHEMA).option("basePath", path).parquet(*files) if files else spark.createDataFrame([], LISTING_SCHEMA)
    if bucket is not None:
        rows = rows.where(F.col("bucket") == bucket)
    return apply_filters(under(rows, prefix), filters)
