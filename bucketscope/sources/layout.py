"""Whether inventory files have the layout of a listing: every file, not a sample.

Spark fills columns that a file lacks with NULL, and filters then drop its rows without an error. Files that carry a schema
(Parquet, ORC) have it read by tasks, and the distinct layouts are checked before anything is listed. Rows of files that
do not (JSON, CSV), and rows that arrive in a stream, are checked one by one as they are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.schema import LISTING_SCHEMA, OBJECT, PREFIX
from bucketscope.session import ship_package

REQUIRED = ("bucket", "entry_type", "key", "size", "last_modified")
FILES_PER_TASK = 200
#: Distinct layouts that come to the driver; one more is an error anyway.
MOST_LAYOUTS = 1000


def check_columns(found: dict[str, str], where: str) -> None:
    """Raise where a layout (Spark type names by column) lacks a column that listings need, or has one of another type."""
    if missing := [c for c in REQUIRED if c not in found]:
        raise ValueError(f"{where} has no column {', '.join(missing)}")
    for field in LISTING_SCHEMA.fields:
        wanted = field.dataType.simpleString()
        if field.name in found and found[field.name] not in (wanted, _FROM_PATH):
            raise ValueError(f"{where}: {field.name} is {found[field.name]}, not {wanted}")


#: The type of a column that comes from the names of directories
_FROM_PATH = "path"


def kind_name(kind: pa.DataType) -> str:
    """The name of the Spark type that a file's type is read as; whole numbers and timestamps are read whatever their width."""
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return "string"
    if pa.types.is_signed_integer(kind):
        return "bigint"
    if pa.types.is_timestamp(kind):
        return "timestamp"
    if pa.types.is_boolean(kind):
        return "boolean"
    if pa.types.is_dictionary(kind):
        return kind_name(kind.value_type)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return f"array<{kind_name(kind.value_type)}>"
    return str(kind)


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, length`` of the files that Spark reads below a path."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("path").alias("file"), "length")


def _file_layout(file: str, form: str, fields: Sequence[str]) -> list[tuple[str, str]]:
    """Columns of a listing and their types, from the file's own schema or the names of its directories."""
    # here, so that Python workers of other operators, which import this package, do not load file systems and readers
    from pyarrow import fs, orc
    from pyarrow import parquet as pq

    system, place = fs.FileSystem.from_uri(file)
    with system.open_input_file(place) as opened:
        schema = pq.read_schema(opened) if form == "parquet" else orc.ORCFile(opened).schema
    own = {f.name: kind_name(f.type) for f in schema if f.name in fields}
    for part in unquote(file).split("/")[:-1]:
        name, equals, _ = part.partition("=")
        if equals and name in fields:
            own[name] = _FROM_PATH
    return sorted(own.items())


def layouts(spark: SparkSession, path: str, form: str) -> list[tuple[str, dict[str, str], int]]:
    """Each distinct layout of the files below ``path``: an example file, types by column, and how many files have it.

    Footers are read by tasks, grouped there and by Spark, so the driver sees layouts and not files. A file that cannot be
    read raises. Where Arrow does not know the file system, see :func:`_layouts_by_rows`.
    """
    from pyarrow import fs

    files = data_files(spark, path)
    first = files.first()
    if first is None:
        raise ValueError(f"no files at {path}")
    try:
        fs.FileSystem.from_uri(first["file"])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return _layouts_by_rows(spark, path, form)
    ship_package(spark)
    names = LISTING_SCHEMA.fieldNames()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_file_layout(file, form, names) for file in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.map_(pa.string(), pa.string()))], names=["file", "layout"])

    dealt = files.select("file").repartition(max(1, -(-files.count() // FILES_PER_TASK)))
    seen = dealt.mapInArrow(read, "file string, layout map<string,string>").select("file", F.array_sort(F.map_entries("layout")).alias("layout"))
    grouped = seen.groupBy("layout").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("files"))
    return [(r["file"], dict(map(tuple, r["layout"])), r["files"]) for r in grouped.orderBy("file").limit(MOST_LAYOUTS).collect()]


def _layouts_by_rows(spark: SparkSession, path: str, form: str) -> list[tuple[str, dict[str, str], int]]:
    """As :func:`layouts`, by Spark alone: a required column is absent from a file whose rows all lack it. A column of another
    type fails the read itself."""
    rows = spark.read.schema(LISTING_SCHEMA).format(form).load(path)
    counted = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(*[(F.count(c) > 0).alias(c) for c in REQUIRED])
    kinds = {f.name: f.dataType.simpleString() for f in LISTING_SCHEMA.fields}
    grouped = counted.groupBy(*REQUIRED).agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("files"))
    return [(r["file"], {c: kinds[c] for c in REQUIRED if r[c]}, r["files"]) for r in grouped.collect()]


def check_files(spark: SparkSession, path: str, form: str) -> None:
    """Raise where any file below ``path`` has another layout than a listing's."""
    for file, found, files in layouts(spark, path, form):
        check_columns(found, f"{file} and {files - 1} more files like it" if files > 1 else file)


def check_rows(df: DataFrame) -> DataFrame:
    """The rows, of which one without a value that listings need fails the query.

    Bucket, kind and key are needed always, the size of an object, and the date of all but directories. The test names the
    file, which Spark only knows as it reads; for that it leaves the test where it is and pushes no other filter below it.
    So the scan still reads only the columns that are asked for and tested, but skips no row groups.
    """
    kind = F.col("entry_type")
    held = F.col("bucket").isNotNull() & kind.isNotNull() & F.col("key").isNotNull()
    held = held & (F.col("size").isNotNull() | (kind != OBJECT)) & (F.col("last_modified").isNotNull() | (kind == PREFIX))
    problem = F.raise_error(F.concat(F.lit("a row without a value that listings need, in "), F.input_file_name()))
    return df.where(F.when(F.coalesce(held, F.lit(False)), F.lit(True)).otherwise(problem.cast("boolean")))

