"""Table layouts shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

OBJECT = "OBJECT"
PREFIX = "PREFIX"
DELETE_MARKER = "DELETE_MARKER"

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("bucket", T.StringType(), False),
        T.StructField("entry_type", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("size", T.LongType()),
        T.StructField("last_modified", T.TimestampType()),
        T.StructField("e_tag", T.StringType()),
        T.StructField("storage_class", T.StringType()),
        T.StructField("checksum_algorithm", T.ArrayType(T.StringType())),
        T.StructField("checksum_type", T.StringType()),
        T.StructField("owner_display_name", T.StringType()),
        T.StructField("owner_id", T.StringType()),
        T.StructField("is_restore_in_progress", T.BooleanType()),
        T.StructField("restore_expiry_date", T.StringType()),
        T.StructField("version_id", T.StringType()),
        T.StructField("is_latest", T.BooleanType()),
    ]
)

BUCKET_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("creation_date", T.TimestampType()),
        T.StructField("region", T.StringType()),
        T.StructField("bucket_arn", T.StringType()),
        T.StructField("owner_display_name", T.StringType()),
        T.StructField("owner_id", T.StringType()),
    ]
)

PAGE_LOG_SCHEMA = T.StructType(
    [
        T.StructField("bucket", T.StringType(), False),
        T.StructField("prefix", T.StringType()),
        T.StructField("mode", T.StringType(), False),
        T.StructField("page_no", T.LongType(), False),
        T.StructField("is_truncated", T.BooleanType()),
        T.StructField("next_token", T.StringType()),
        T.StructField("next_key_marker", T.StringType()),
        T.StructField("next_version_id_marker", T.StringType()),
    ]
)
