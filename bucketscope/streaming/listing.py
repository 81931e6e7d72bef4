"""Streaming listings. The same filter and directory expressions as in batch; a failing row fails the query."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from bucketscope.functions.keys import prefix_at_depth
from bucketscope.operators.filters import FilterConfig, apply_filters
from bucketscope.operators.summary import total_columns
from bucketscope.plans.listing import entries
from bucketscope.schema import PREFIX
from bucketscope.session import ship_package, stored
from bucketscope.sources.layout import check_files, check_rows
from bucketscope.sources.targets import under

SALTS = 16
#: Folders of micro-batches that are merged into one.
MERGED = 16
PREFIX_SCHEMA = "bucket string, entry_type string, key string"


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Inventory files as a stream; ``files_per_trigger`` bounds each micro-batch.

    ``schema`` holds the columns that listings need. Files that are there must have them all, with their types, or
    ``ValueError`` is raised. Of those that arrive later, a row without a value that listings need stops the stream, before
    anything of its micro-batch is committed.
    """
    if not _path(spark, path).exists():
        raise ValueError(f"no inventory at {path}")
    if has_files(spark, path):
        check_files(spark, path, "parquet")
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return check_rows(reader.parquet(path))


def stream_listing(
    sdf: DataFrame, config: FilterConfig = FilterConfig(), prefix: str | None = None, *, whole: bool = True, **options
) -> DataFrame:
    """Rows that pass, as they arrive; keeps no state.

    With ``whole=False`` all stages of a listing take part, in its order: bucket, mode, directories, hidden markers, hidden
    directories, filters (the options of :func:`~bucketscope.plans.listing.entries`, one level unless ``recursive`` or
    ``max_depth`` is given). Directories are then told once each, from the first key below them, for which the stream
    keeps those it has told; where they are too many for that, take :func:`emit_prefixes` and ``objects_only``.
    """
    if whole:
        if options:
            raise ValueError(f"options of a staged listing: {', '.join(sorted(options))}")
        return apply_filters(under(sdf, prefix), config)
    return entries(sdf, prefix=prefix, filters=config, **options)


def stream_prefixes(sdf: DataFrame, prefix: str | None = None, depth: int = 1) -> DataFrame:
    """Each directory at the boundary once, when a key below it first arrives.

    State holds every directory seen, up to ``SALTS`` times, and has no watermark: it grows with the number of
    directories, not of keys. Tasks merge the repeats of a batch of rows before these are shuffled and looked up. Repeats
    are then dropped per salt first, so those of a hot directory do not all go to one task.
    """
    ship_package(sdf.sparkSession)
    prefix = prefix or ""
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("_salt")
    found = under(sdf, prefix).select("bucket", prefix_at_depth(F.col("key"), prefix, depth).alias("at"), salt)
    found = found.filter(F.col("at").isNotNull())
    found = found.mapInArrow(_merged, found.schema).dropDuplicates(["bucket", "at", "_salt"])
    once = found.dropDuplicates(["bucket", "at"])
    return once.select("bucket", F.lit(PREFIX).alias("entry_type"), F.col("at").alias("key"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([]).to_batches()


def emit_prefixes(sdf: DataFrame, path: str, checkpoint: str, prefix: str | None = None, depth: int = 1) -> StreamingQuery:
    """Process what is available and write each directory at the boundary once below ``path``, with no stream state.

    What was written is what was seen: the directories of a micro-batch are looked up in the folders of those before it,
    and the new ones become a folder of their own, so a batch that runs again finds the same and overwrites itself. Folders
    are sorted, and a batch reads only the part of them between its first and last directory. After ``MERGED`` folders they
    are merged into one. :func:`read_prefixes` reads what is complete.
    """
    _checked(sdf.sparkSession, path, checkpoint, None)
    prefix = prefix or ""
    found = under(sdf, prefix).select("bucket", prefix_at_depth(F.col("key"), prefix, depth).alias("key"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _merge(spark, path, batch_id)
        new = stored(batch.where("key is not null").distinct(), "prefixes")
        least, most = new.agg(F.min(F.struct("bucket", "key")), F.max(F.struct("bucket", "key"))).first()
        before = _seen(spark, path, batch_id)
        if before is not None and least is not None:
            place = F.col("bucket").between(least["bucket"], most["bucket"])
            if least["bucket"] == most["bucket"]:
                place = place & F.col("key").between(least["key"], most["key"])
            again = before.where(place).select("bucket", "key").join(new, ["bucket", "key"], "left_semi")
            new = new.join(again, ["bucket", "key"], "left_anti")
        rows = new.select("bucket", F.lit(PREFIX).alias("entry_type"), "key")
        rows.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _complete(spark: SparkSession, path: str, kind: str) -> list[int]:
    names = [n.removeprefix(f"{kind}-") for n in _path(spark, path).names() if n.startswith(f"{kind}-")]
    return sorted(int(n) for n in names if _path(spark, f"{path}/{kind}-{n}/_SUCCESS").exists())


def _folders(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """Folders that hold what batches before ``before`` (or all) have seen: the newest merged one, and those after it."""
    merged = [n for n in _complete(spark, path, "merged") if before is None or n < before]
    since = merged[-1] if merged else -1
    batches = [n for n in _complete(spark, path, "batch") if n > since and (before is None or n < before)]
    return [f"{path}/merged-{n}" for n in merged[-1:]] + [f"{path}/batch-{n}" for n in batches]


def _seen(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    folders = _folders(spark, path, before)
    return spark.read.schema(PREFIX_SCHEMA).parquet(*folders) if folders else None


def _merge(spark: SparkSession, path: str, batch_id: int) -> None:
    """Merge the folders of the batches before this one when they are many, then drop what the one before held."""
    folders = _folders(spark, path, batch_id)
    if len(folders) <= MERGED:
        return
    rows = spark.read.schema(PREFIX_SCHEMA).parquet(*folders)
    ordered = rows.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    ordered.write.mode("overwrite").parquet(f"{path}/merged-{batch_id - 1}")
    for folder in folders:
        _path(spark, folder).delete()


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """The directories that :func:`emit_prefixes` has written so far."""
    found = _seen(spark, path)
    if found is None:
        raise ValueError(f"no prefixes at {path}")
    return found


def stream_summary(sdf: DataFrame, by: Sequence[str | Column] = ("bucket",)) -> DataFrame:
    """Running totals per group, for ``update`` or ``complete`` output."""
    return sdf.groupBy(*by).agg(*total_columns())


class _path:
    """A path in whatever file system it names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.system.exists(self.path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.system.listStatus(self.path)] if self.exists() else []

    def delete(self) -> None:
        self.system.delete(self.path, True)


def has_files(spark: SparkSession, path: str) -> bool:
    return any(n.endswith(".parquet") or "=" in n for n in _path(spark, path).names())


def _checked(spark: SparkSession, path: str, checkpoint: str, log: str | None) -> None:
    """Refuse a path that a query with another checkpoint has written to.

    The sink keeps a log of its own at the path. A new checkpoint counts batches from 0 again, which the log has as
    written: they would be skipped without an error.
    """
    merged = any(n.startswith("merged-") for n in _path(spark, path).names())
    written = _path(spark, f"{path}/{log}").exists() if log else merged or bool(_batches(spark, path))
    if written and not _path(spark, f"{checkpoint}/metadata").exists():
        raise ValueError(f"{path} was written with another checkpoint than {checkpoint}")


def append_to(sdf: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is available and append it to Parquet files at ``path``.

    ``checkpoint`` remembers what was processed; the next call with it goes on from there.
    """
    _checked(sdf.sparkSession, path, checkpoint, "_spark_metadata")
    return (
        sdf.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def refresh_totals(sdf: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is available and write the totals to a new folder below ``path`` after each micro-batch.

    ``read_totals`` reads the newest folder that is complete, so readers always find whole totals. The folder before it
    is kept for those that are still reading; older ones go.
    """
    spark = sdf.sparkSession
    _checked(spark, path, checkpoint, None)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
        for old in _batches(batch.sparkSession, path):
            if old < batch_id - 1:
                _path(batch.sparkSession, f"{path}/batch-{old}").delete()

    return (
        sdf.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("batch-")) for n in _path(spark, path).names() if n.startswith("batch-"))


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the newest complete micro-batch."""
    for batch in reversed(_batches(spark, path)):
        if _path(spark, f"{path}/batch-{batch}/_SUCCESS").exists():
            return spark.read.parquet(f"{path}/batch-{batch}")
    raise ValueError(f"no totals at {path}")
