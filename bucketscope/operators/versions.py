"""Views over version tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bucketscope.operators.sorting import sort_listing
from bucketscope.sources.inventory import objects


def current_view(versions: DataFrame) -> DataFrame:
    """What a listing of current objects shows for a version table: latest versions that are not markers."""
    return objects(versions)


def history(versions: DataFrame) -> DataFrame:
    """Versions and markers of each key in order of time."""
    return sort_listing(versions, ["key"], versions=True)
