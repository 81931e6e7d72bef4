"""Writing listings: rendered lines in order, or typed tables, each with its total from the same pass over the rows.

A listing is written below a staging folder beside its path: rows first, then header and total, whose numbers were counted
while the rows were written. Only then does the folder get the listing's name, so what can be read is whole, and what failed
is not there. The files, read by name, are header, rows in order and total.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bucketscope.operators.sorting import bucket_order, listing_order
from bucketscope.operators.summary import total_columns
from bucketscope.plans.display import Display
from bucketscope.plans.render import bucket_line, header, listing_line, summary_line
from bucketscope.plans.skew import line_numbers

#: File names before and after those of the rows (``part-00000-...``) by name.
HEADER, TOTAL = "part--header.txt", "part-total.txt"
MODES = ("errorifexists", "error", "overwrite", "ignore")


@contextmanager
def published(spark: SparkSession, path: str, mode: str = "errorifexists") -> Iterator["Staging"]:
    """A staging folder that becomes ``path`` when the block ends, and goes when it fails."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    staging = Staging(spark, path)
    if mode not in ("overwrite", "ignore") and staging.system.exists(staging.target):
        raise ValueError(f"{path} already exists")
    try:
        yield staging
        if not staging.system.exists(staging.folder):
            return
        if mode == "overwrite":
            staging.system.delete(staging.target, True)
        staging.system.mkdirs(staging.target.getParent())
        if not staging.system.rename(staging.folder, staging.target):
            raise OSError(f"could not give the listing its name {path}")
    finally:
        staging.system.delete(staging.folder, True)


class Staging:
    def __init__(self, spark: SparkSession, path: str):
        paths = spark._jvm.org.apache.hadoop.fs.Path
        self.path = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
        self.folder, self.target = paths(self.path), paths(path.rstrip("/"))
        self.system = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.system.exists(self.target)

    def add_file(self, name: str, text: str) -> None:
        """One small file, made on the driver."""
        out = self.system.create(self.folder.suffix(f"/{name}"))
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


class Totals:
    """The total of rows, counted by the job that writes them."""

    def __init__(self) -> None:
        self.observation = Observation(f"totals-{uuid.uuid4().hex}")

    def counted(self, df: DataFrame) -> DataFrame:
        """To be put above any sort: what is below one runs again to sample its ranges, and would be counted twice."""
        return df.observe(self.observation, *total_columns())

    def row(self, spark: SparkSession) -> DataFrame:
        found = self.observation.get
        names = ("total_objects", "total_size", "total_delete_markers")
        # of an input that Spark knows to be empty nothing is counted
        return spark.range(1).select(*[F.lit(found.get(n, 0)).cast("bigint").alias(n) for n in names])


def write_listing(
    df: DataFrame,
    path: str,
    form: str = "tsv",
    show: Display = Display(),
    *,
    sort: Sequence[str] | None = ("key",),
    reverse: bool = False,
    with_header: bool = False,
    summary: bool = False,
    mode: str = "errorifexists",
    compression: str | None = None,
) -> None:
    """Write a listing to ``path``: ``tsv``, ``aligned``, ``lines``, ``json`` (NDJSON) or ``parquet``.

    The rows are range-partitioned and sorted, and counted as they are written; with ``sort=None`` they keep the partitions
    they have, and the input is evaluated once. A typed table has no place for a header or a total: asking for them raises;
    see :func:`write_with_summary`. ``mode`` is ``errorifexists``, ``overwrite`` or ``ignore``. ``compression``, such as
    ``gzip``, is that of the rows' files; header and total are plain, and Spark reads them as one listing.
    """
    if form == "parquet" and (with_header or summary):
        raise ValueError("a parquet listing has no header and no total; see write_with_summary")
    keys = [k.order() for k in listing_order(sort, reverse, show.versions)] if sort is not None else []
    title = header(form, show) if with_header and form != "parquet" else None
    with published(df.sparkSession, path, mode) as staging:
        if mode == "ignore" and staging.exists():
            return
        rows = df.orderBy(*keys) if keys else df
        if form == "parquet":
            rows.write.parquet(staging.path, compression=compression)
            return
        _write_lines(rows, staging, listing_line(form, show), title, summary_line(form, show) if summary else None, compression)


def _write_lines(
    rows: DataFrame, staging: Staging, line: Column, title: str | None, total: Column | None, compression: str | None = None
) -> None:
    totals = Totals()
    counted = totals.counted(rows) if total is not None else rows
    counted.select(line.alias("value")).write.text(staging.path, compression=compression)
    if title is not None:
        staging.add_file(HEADER, title + "\n")
    if total is not None:
        staging.add_file(TOTAL, totals.row(rows.sparkSession).select(total).first()[0] + "\n")


def write_buckets(
    df: DataFrame,
    path: str,
    form: str = "aligned",
    show: Display = Display(),
    *,
    sort: Sequence[str] | None = ("bucket",),
    reverse: bool = False,
    with_header: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Write a bucket listing to ``path`` in one call: sorted, with or without a header, as ``tsv``, ``aligned``, ``lines`` or
    ``json``. Files and modes are those of :func:`write_listing`."""
    keys = [k.order() for k in bucket_order(sort, reverse)] if sort is not None else []
    title = header(form, show, buckets=True) if with_header else None
    with published(df.sparkSession, path, mode) as staging:
        if mode == "ignore" and staging.exists():
            return
        _write_lines(df.orderBy(*keys) if keys else df, staging, bucket_line(form, show), title, None)


def write_with_summary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write rows and their total as one typed table, from one evaluation of the rows: ``section`` is 0 for rows and 1 for the
    total, as in :func:`~bucketscope.operators.summary.with_summary`. Read it with :func:`read_with_summary`."""
    totals = Totals()
    with published(df.sparkSession, path, mode) as staging:
        if mode == "ignore" and staging.exists():
            return
        totals.counted(df).write.parquet(f"{staging.path}/section=0")
        totals.row(df.sparkSession).write.parquet(f"{staging.path}/section=1")


def read_with_summary(spark: SparkSession, path: str) -> DataFrame:
    """Rows and total of :func:`write_with_summary`, as one table."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a written listing with their place in it, ``pos`` from 1: by file name, then by line."""
    at = F.col("_metadata")
    lines = spark.read.text(path).select(
        "value", at["file_name"].alias("_file"), at["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_line")
    )
    return line_numbers(lines, [F.col("_file"), F.col("_block"), F.col("_line")]).select("pos", "value")
