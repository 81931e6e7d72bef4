"""Listing and bucket orders. Sorts are range-partitioned and spill; ties end in bucket, key and version."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.schema import OBJECT

FIELDS = {"objects": ("key", "size", "date"), "buckets": ("bucket", "region", "date")}
DEFAULT_FIELD = {"objects": "key", "buckets": "bucket"}


@dataclass(frozen=True)
class SortKey:
    """An expression with its direction, kept apart so that it can be selected first and ordered by later."""

    column: Column
    descending: bool = False
    nulls_first: bool = False

    def order(self, column: Column | None = None) -> Column:
        value = self.column if column is None else column
        if self.descending:
            return value.desc_nulls_first() if self.nulls_first else value.desc_nulls_last()
        return value.asc_nulls_first() if self.nulls_first else value.asc_nulls_last()


def validate_sort(fields: Sequence[str] | None, mode: str = "objects", versions: bool = False) -> list[str]:
    """The fields to sort by, with defaults; version listings sorted by one other field get ``date`` added."""
    fields = list(fields) if fields else [DEFAULT_FIELD[mode]]
    for field in fields:
        if field not in FIELDS[mode]:
            raise ValueError(f"cannot sort {mode} by {field!r}; use one of {', '.join(FIELDS[mode])}")
    if len(set(fields)) < len(fields):
        raise ValueError("duplicate sort field")
    if len(fields) > 2:
        raise ValueError("at most 2 sort fields")
    if versions and fields != ["date"] and len(fields) == 1:
        fields.append("date")
    return fields


def listing_order(
    fields: Sequence[str] | None = None, reverse: bool = False, versions: bool = False
) -> list[SortKey]:
    """Sort keys of a listing. Directories have no date and come last by date; they and markers have size 0."""
    size = F.when(F.col("entry_type") == OBJECT, F.coalesce("size", F.lit(0))).otherwise(F.lit(0))
    values = {"key": F.col("key"), "size": size, "date": F.col("last_modified")}
    chosen = [SortKey(values[f], reverse, nulls_first=reverse) for f in validate_sort(fields, "objects", versions)]
    return chosen + [SortKey(F.col(name)) for name in ("bucket", "key", "version_id", "entry_type")]


def sort_listing(
    df: DataFrame, fields: Sequence[str] | None = None, reverse: bool = False, versions: bool = False
) -> DataFrame:
    return df.orderBy(*[k.order() for k in listing_order(fields, reverse, versions)])


def bucket_order(fields: Sequence[str] | None = None, reverse: bool = False) -> list[SortKey]:
    """Sort keys of a bucket listing; missing dates and regions come first."""
    values = {"bucket": F.col("name"), "region": F.col("region"), "date": F.col("creation_date")}
    chosen = [SortKey(values[f], reverse, nulls_first=not reverse) for f in validate_sort(fields, "buckets")]
    return [*chosen, SortKey(F.col("name"))]


def sort_buckets(df: DataFrame, fields: Sequence[str] | None = None, reverse: bool = False) -> DataFrame:
    return df.orderBy(*[k.order() for k in bucket_order(fields, reverse)])
