"""Listing scans over inventory tables, and normalisation of raw inventory rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketscope.functions.scalars import fmt_ts
from bucketscope.schema import BUCKET_SCHEMA, DELETE_MARKER, LISTING_SCHEMA, OBJECT
from bucketscope.sources.layout import check_files, check_rows

DIRECTORY_BUCKET_SUFFIX = "--x-s3"  # fixed value: name ending of directory buckets


def _conform(df: DataFrame, **values: Column) -> DataFrame:
    """``LISTING_SCHEMA`` columns, from ``values`` first, then from ``df``, else NULL."""
    columns = []
    for field in LISTING_SCHEMA.fields:
        if field.name in values:
            column = values[field.name]
        elif field.name in df.columns:
            column = F.col(field.name)
        else:
            column = F.lit(None)
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(columns)


def read_inventory(spark: SparkSession, path: str, form: str = "parquet", line_breaks: bool = False) -> DataFrame:
    """An inventory in listing columns from ``parquet``, ``orc``, ``json`` or ``csv`` files; no schema inference.

    CSV files have a header with the listing columns, and checksum algorithms joined by commas. With ``line_breaks``
    their quoted keys may hold such; a file is then read by one task, without it in splits.

    Parquet and ORC files have all their footers read, by tasks: one that lacks a required column, or has a column with
    another type, raises ``ValueError``. In JSON and CSV a row without a required value fails the query that reads it. The
    other columns may be absent and are then NULL.
    """
    if form in ("parquet", "orc"):
        check_files(spark, path, form)
        return spark.read.schema(LISTING_SCHEMA).format(form).load(path)
    if form == "json":
        return check_rows(spark.read.schema(LISTING_SCHEMA).option("mode", "FAILFAST").json(path))
    if form != "csv":
        raise ValueError(f"unknown inventory form {form!r}")
    flat = T.StructType([
        T.StructField(f.name, T.StringType()) if f.name == "checksum_algorithm" else f for f in LISTING_SCHEMA.fields
    ])
    options = {"header": True, "mode": "FAILFAST", "escape": '"', "enforceSchema": False, "multiLine": line_breaks}
    rows = check_rows(spark.read.schema(flat).options(**options).csv(path))
    listed = F.coalesce(F.split("checksum_algorithm", ","), F.array().cast("array<string>"))
    return rows.withColumns({"checksum_algorithm": listed, "e_tag": F.coalesce("e_tag", F.lit(""))})


def objects(df: DataFrame, bucket: str | None = None) -> DataFrame:
    """Current objects of one bucket, or of all; no version columns.

    Of a version table these are the latest versions that are not delete markers; an unversioned object is current.
    """
    if bucket is not None:
        df = df.filter(F.col("bucket") == bucket)
    if "entry_type" in df.columns:
        df = df.filter(F.col("entry_type") == OBJECT)
    if "is_latest" in df.columns:
        # not coalesce, which would keep the test from the scan
        df = df.filter(F.col("is_latest") | F.col("is_latest").isNull())
    return _conform(df, entry_type=F.lit(OBJECT), version_id=F.lit(None), is_latest=F.lit(None))


def versions(df: DataFrame, bucket: str | None = None) -> DataFrame:
    """All versions and delete markers of one bucket, or of all."""
    if bucket is not None:
        df = df.filter(F.col("bucket") == bucket)
    return _conform(df)


def buckets(df: DataFrame, name_prefix: str | None = None) -> DataFrame:
    """Bucket table in ``BUCKET_SCHEMA`` layout, optionally only names with a prefix."""
    if name_prefix:
        df = df.filter(F.col("name").startswith(name_prefix))
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in BUCKET_SCHEMA.fields
    ])


def directory_buckets(df: DataFrame, name_prefix: str | None = None) -> DataFrame:
    """Only directory buckets, which report no owner."""
    named = buckets(df, name_prefix).filter(F.col("name").endswith(DIRECTORY_BUCKET_SUFFIX))
    nothing = F.lit(None).cast("string")
    return named.withColumns({"owner_display_name": nothing, "owner_id": nothing})


def _whole_second_text(column: str, df: DataFrame) -> Column:
    if column in df.columns and df.schema[column].dataType.typeName() == "timestamp":
        return fmt_ts(F.col(column))
    return F.col(column) if column in df.columns else F.lit(None)


def _usable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("key").isNotNull() & F.col("last_modified").isNotNull())


def _stored(df: DataFrame) -> dict[str, Column]:
    no_checksum = F.array().cast("array<string>")
    given = F.col("checksum_algorithm") if "checksum_algorithm" in df.columns else F.lit(None)
    tag = F.col("e_tag") if "e_tag" in df.columns else F.lit(None)
    return {
        "entry_type": F.lit(OBJECT),
        "size": F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0)),
        "e_tag": F.coalesce(tag.cast("string"), F.lit("")),
        "checksum_algorithm": F.coalesce(given.cast("array<string>"), no_checksum),
        "restore_expiry_date": _whole_second_text("restore_expiry_date", df),
    }


def _versioned() -> dict[str, Column]:
    return {
        "version_id": F.coalesce(F.col("version_id"), F.lit("null")),
        "is_latest": F.coalesce(F.col("is_latest"), F.lit(False)),
    }


def normalize_objects(raw: DataFrame) -> DataFrame:
    """Raw object rows: rows without key or date go, missing or negative sizes become 0, a missing tag ''."""
    unversioned = {"version_id": F.lit(None), "is_latest": F.lit(None)}
    return _conform(_usable(raw), **_stored(raw), **unversioned)


def normalize_versions(raw: DataFrame) -> DataFrame:
    """As :func:`normalize_objects`, with a missing version ``'null'`` and a missing latest flag false."""
    return _conform(_usable(raw), **_stored(raw), **_versioned())


def normalize_delete_markers(raw: DataFrame) -> DataFrame:
    """Delete markers carry key, version, date and owner; nothing about stored bytes."""
    kept = ("bucket", "key", "last_modified", "owner_display_name", "owner_id", "version_id", "is_latest")
    narrow = _usable(raw).select([c for c in kept if c in raw.columns])
    return _conform(
        narrow,
        entry_type=F.lit(DELETE_MARKER),
        size=F.lit(0),
        e_tag=F.lit(""),
        checksum_algorithm=F.array().cast("array<string>"),
        **_versioned(),
    )


def with_optional(df: DataFrame, owner: bool = False, restore: bool = False, versions: bool = False) -> DataFrame:
    """NULL the owner and restore attributes that were not asked for; version listings always have the owner.

    The dropped columns leave the scan too.
    """
    dropped: list[str] = []
    if not (owner or versions):
        dropped += ["owner_display_name", "owner_id"]
    if not restore:
        dropped += ["is_restore_in_progress", "restore_expiry_date"]
    types = {name: df.schema[name].dataType for name in dropped}
    return df.withColumns({name: F.lit(None).cast(types[name]) for name in dropped}) if dropped else df
