"""Reading written NDJSON listings back into the listing layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.schema import DELETE_MARKER, OBJECT, PREFIX
from bucketscope.sources.inventory import _conform

RECORD_SCHEMA = """
    Key string, LastModified string, ETag string, ChecksumAlgorithm array<string>, ChecksumType string, Size bigint,
    StorageClass string, VersionId string, IsLatest boolean, Owner struct<DisplayName: string, ID: string>,
    RestoreStatus struct<IsRestoreInProgress: boolean, RestoreExpiryDate: string>, Prefix string, DeleteMarker boolean,
    Summary struct<TotalObjects: bigint, TotalSize: bigint, TotalDeleteMarkers: bigint>
"""


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as written: objects, prefixes, delete markers and summaries. A malformed line fails the read."""
    return spark.read.schema(RECORD_SCHEMA).option("mode", "FAILFAST").json(path)


def read_listing_json(spark: SparkSession, path: str, bucket: str = "") -> DataFrame:
    """The entries of a written listing; records do not name their bucket, so the caller does."""
    records = read_records(spark, path).filter(F.col("Summary").isNull())
    kind = F.when(F.col("Prefix").isNotNull(), PREFIX).when(F.col("DeleteMarker"), DELETE_MARKER).otherwise(OBJECT)
    stored = F.col("Prefix").isNull() & F.col("DeleteMarker").isNull()
    return _conform(
        records,
        bucket=F.lit(bucket),
        entry_type=kind,
        key=F.coalesce("Prefix", "Key"),
        size=F.coalesce("Size", F.lit(0)),
        last_modified=F.to_timestamp("LastModified"),
        e_tag=F.coalesce("ETag", F.lit("")),
        storage_class=F.col("StorageClass"),
        checksum_algorithm=F.coalesce("ChecksumAlgorithm", F.when(stored, F.array().cast("array<string>"))),
        checksum_type=F.col("ChecksumType"),
        owner_display_name=F.col("Owner.DisplayName"),
        owner_id=F.col("Owner.ID"),
        is_restore_in_progress=F.col("RestoreStatus.IsRestoreInProgress"),
        restore_expiry_date=F.col("RestoreStatus.RestoreExpiryDate"),
        version_id=F.col("VersionId"),
        is_latest=F.col("IsLatest"),
    )


def read_summary_json(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path).filter(F.col("Summary").isNotNull()).select("Summary.*")
