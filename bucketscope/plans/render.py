"""Rendered forms: each listing row, bucket row or total as one line of text or JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.functions.scalars import escape_ctl, fmt_size_split, fmt_ts
from bucketscope.plans.display import Cell, Display, bucket_cells, listing_cells
from bucketscope.schema import DELETE_MARKER, PREFIX

GAP = "  "  # fixed value: between aligned columns
JSON_OPTIONS = {"ignoreNullFields": "true"}
TEXT_FORMS = ("tsv", "aligned", "lines")


def _padded(text: Column, width: int, right: bool) -> Column:
    """Padded to ``width`` characters; longer text stays whole."""
    fill = F.lpad if right else F.rpad
    return fill(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def _joined(cells: Sequence[Cell], form: str) -> Column:
    if form == "tsv":
        return F.concat_ws("\t", *[c.text for c in cells])
    return F.concat_ws(GAP, *[c.text if c.width is None else _padded(c.text, c.width, c.right) for c in cells])


def listing_line(form: str, show: Display = Display()) -> Column:
    """A listing row as text (``tsv``, ``aligned``, ``lines``) or ``json``."""
    if form == "json":
        return _entry_json(show)
    if form == "lines":
        return escape_ctl(show.show_key(), show.raw)
    if form not in TEXT_FORMS:
        raise ValueError(f"unknown form {form!r}")
    return _joined(listing_cells(show), form)


def bucket_line(form: str, show: Display = Display()) -> Column:
    if form == "json":
        return _bucket_json(show)
    if form == "lines":
        return escape_ctl(F.col("name"), show.raw)
    if form not in TEXT_FORMS:
        raise ValueError(f"unknown form {form!r}")
    return _joined(bucket_cells(show), form)


def _owner_json() -> Column:
    named = F.col("owner_display_name").isNotNull() | F.col("owner_id").isNotNull()
    return F.when(named, F.struct(F.col("owner_display_name").alias("DisplayName"), F.col("owner_id").alias("ID")))


def _entry_json(show: Display) -> Column:
    key, date = show.show_key(), fmt_ts(F.col("last_modified"), show.tz)
    prefix = F.to_json(F.struct(key.alias("Prefix")), JSON_OPTIONS)
    marker = F.struct(
        key.alias("Key"),
        F.col("version_id").alias("VersionId"),
        F.col("is_latest").alias("IsLatest"),
        date.alias("LastModified"),
        F.lit(True).alias("DeleteMarker"),
        _owner_json().alias("Owner"),
    )
    restore = F.struct(
        F.col("is_restore_in_progress").alias("IsRestoreInProgress"),
        F.col("restore_expiry_date").alias("RestoreExpiryDate"),
    )
    checksums = F.when(F.size("checksum_algorithm") > 0, F.col("checksum_algorithm"))
    stored = F.struct(
        key.alias("Key"),
        date.alias("LastModified"),
        F.coalesce("e_tag", F.lit("")).alias("ETag"),
        checksums.alias("ChecksumAlgorithm"),
        F.col("checksum_type").alias("ChecksumType"),
        F.coalesce("size", F.lit(0)).alias("Size"),
        F.col("storage_class").alias("StorageClass"),
        F.col("version_id").alias("VersionId"),
        F.when(F.col("version_id").isNotNull(), F.coalesce("is_latest", F.lit(False))).alias("IsLatest"),
        _owner_json().alias("Owner"),
        F.when(F.col("is_restore_in_progress").isNotNull(), restore).alias("RestoreStatus"),
    )
    kind = F.col("entry_type")
    return (
        F.when(kind == PREFIX, prefix)
        .when(kind == DELETE_MARKER, F.to_json(marker, JSON_OPTIONS))
        .otherwise(F.to_json(stored, JSON_OPTIONS))
    )


def _bucket_json(show: Display) -> Column:
    fields = [
        F.col("name").alias("Name"),
        fmt_ts(F.col("creation_date"), show.tz).alias("CreationDate"),
        F.col("region").alias("BucketRegion"),
        F.col("bucket_arn").alias("BucketArn"),
    ]
    if show.owner:
        fields.append(_owner_json().alias("Owner"))
    return F.to_json(F.struct(*fields), JSON_OPTIONS)


def _lines(df: DataFrame, line: Column) -> DataFrame:
    return df.select(line.alias("value"))


def to_tsv(df: DataFrame, show: Display = Display()) -> DataFrame:
    return _lines(df, listing_line("tsv", show))


def to_aligned(df: DataFrame, show: Display = Display()) -> DataFrame:
    return _lines(df, listing_line("aligned", show))


def to_lines(df: DataFrame, show: Display = Display()) -> DataFrame:
    return _lines(df, listing_line("lines", show))


def to_json(df: DataFrame, show: Display = Display()) -> DataFrame:
    return _lines(df, listing_line("json", show))


def buckets_to_text(df: DataFrame, form: str = "aligned", show: Display = Display()) -> DataFrame:
    if form not in TEXT_FORMS:
        raise ValueError(f"unknown form {form!r}")
    return _lines(df, bucket_line(form, show))


def buckets_to_json(df: DataFrame, show_owner: bool = False, tz: str | None = None) -> DataFrame:
    return _lines(df, bucket_line("json", Display(owner=show_owner, tz=tz)))


def summary_line(form: str, show: Display = Display()) -> Column:
    """A row of totals as text, after an empty line, or as JSON; delete markers only in version listings."""
    objects, size, markers = F.col("total_objects"), F.col("total_size"), F.col("total_delete_markers")
    if form == "json":
        totals = [objects.alias("TotalObjects"), size.alias("TotalSize")]
        if show.versions:
            totals.append(markers.alias("TotalDeleteMarkers"))
        return F.to_json(F.struct(F.struct(*totals).alias("Summary")))
    split = fmt_size_split(size)
    number, unit = (split["number"], split["unit"]) if show.human else (size.cast("string"), F.lit("bytes"))
    words = [F.lit("\nTotal:"), objects.cast("string"), F.lit("objects"), number, unit]
    if show.versions:
        words += [markers.cast("string"), F.lit("delete markers")]
    return F.concat_ws("\t" if form == "tsv" else " ", *words)


def summary_text(stats: DataFrame, form: str = "aligned", show: Display = Display()) -> DataFrame:
    return stats.select(summary_line(form, show).alias("value"))


def summary_json(stats: DataFrame, versions: bool = False) -> DataFrame:
    return stats.select(summary_line("json", Display(versions=versions)).alias("value"))


def header(form: str, show: Display = Display(), buckets: bool = False) -> str | None:
    """The header line; JSON has none."""
    if form == "json":
        return None
    if form == "lines":
        return "BUCKET" if buckets else "KEY"
    cells = bucket_cells(show) if buckets else listing_cells(show)
    if form == "tsv":
        return "\t".join(c.name for c in cells)
    return GAP.join(c.name.ljust(c.width or 0) for c in cells)
