"""The listing builder: directories, then marker and directory hiding, then filters, then order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from bucketscope.operators.filters import FilterConfig, apply_filters, hide_delete_markers
from bucketscope.operators.hierarchy import list_level, list_recursive, objects_only as without_prefixes
from bucketscope.operators.sorting import sort_buckets, sort_listing
from bucketscope.sources.inventory import buckets, directory_buckets, objects, versions as version_rows
from bucketscope.sources.inventory import with_optional


def entries(
    df: DataFrame,
    bucket: str | None = None,
    prefix: str | None = None,
    *,
    recursive: bool = False,
    max_depth: int | None = None,
    marker: str = "rollup",
    versions: bool = False,
    hide_markers: bool = False,
    objects_only: bool = False,
    filters: FilterConfig = FilterConfig(),
    owner: bool = True,
    restore: bool = True,
) -> DataFrame:
    """The rows of a listing in any order; of a table or a stream.

    Directories come from the rows of the chosen mode before anything is hidden or filtered, so one that holds only
    delete markers is listed in version mode even where markers are hidden.
    """
    rows = version_rows(df, bucket) if versions else objects(df, bucket)
    rows = with_optional(rows, owner=owner, restore=restore, versions=versions)
    if recursive or max_depth is not None:
        found = list_recursive(rows, prefix, max_depth, marker)
    else:
        found = list_level(rows, prefix)
    if hide_markers:
        found = hide_delete_markers(found)
    if objects_only:
        found = without_prefixes(found)
    return apply_filters(found, filters)


def listing(
    df: DataFrame,
    bucket: str | None = None,
    prefix: str | None = None,
    *,
    sort: Sequence[str] | None = ("key",),
    reverse: bool = False,
    versions: bool = False,
    **options,
) -> DataFrame:
    """A listing of an inventory table as one lazy DataFrame; ``sort=None`` leaves the rows in any order. The other options
    are those of :func:`entries`."""
    found = entries(df, bucket, prefix, versions=versions, **options)
    return found if sort is None else sort_listing(found, sort, reverse, versions)


def bucket_listing(
    df: DataFrame,
    *,
    name_prefix: str | None = None,
    directory: bool = False,
    sort: Sequence[str] | None = ("bucket",),
    reverse: bool = False,
) -> DataFrame:
    """A listing of a bucket table: general purpose buckets, or directory buckets only."""
    rows = directory_buckets(df, name_prefix) if directory else buckets(df, name_prefix)
    return rows if sort is None else sort_buckets(rows, sort, reverse)
