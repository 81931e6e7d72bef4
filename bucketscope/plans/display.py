"""Display columns of listings and bucket tables, in their fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.functions.keys import relative_key
from bucketscope.functions.scalars import escape_ctl, fmt_size, fmt_ts
from bucketscope.schema import DELETE_MARKER, OBJECT, PREFIX


@dataclass(frozen=True)
class Display:
    """What to show and how. ``prefix`` and ``relative`` shorten keys; ``tz`` shows dates in a named zone."""

    human: bool = False
    storage_class: bool = False
    etag: bool = False
    checksum_algorithm: bool = False
    checksum_type: bool = False
    versions: bool = False
    is_latest: bool = False
    owner: bool = False
    restore_status: bool = False
    bucket_arn: bool = False
    relative: bool = False
    prefix: str | None = None
    raw: bool = False
    tz: str | None = None

    def show_key(self) -> Column:
        return relative_key(F.col("key"), self.prefix) if self.relative else F.col("key")


@dataclass(frozen=True)
class Cell:
    """A display column: header, text, and width in aligned output (None for the unpadded last column)."""

    name: str
    text: Column
    width: int | None
    right: bool = False


# Widths of aligned columns.
WIDTHS = {
    "DATE": 25,
    "SIZE": 14,
    "STORAGE_CLASS": 19,
    "ETAG": 38,
    "CHECKSUM_ALGORITHM": 34,
    "CHECKSUM_TYPE": 13,
    "VERSION_ID": 32,
    "IS_LATEST": 10,
    "OWNER_DISPLAY_NAME": 64,
    "OWNER_ID": 64,
    "IS_RESTORE_IN_PROGRESS": 22,
    "RESTORE_EXPIRY_DATE": 25,
    "REGION": 20,
    "BUCKET": 63,
    "BUCKET_ARN": 100,
}
HUMAN_SIZE_WIDTH = 9  # fixed value


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _for_objects(text: Column) -> Column:
    return F.when(F.col("entry_type") == OBJECT, text).otherwise(F.lit(""))


def _unless_prefix(text: Column) -> Column:
    return F.when(F.col("entry_type") == PREFIX, F.lit("")).otherwise(text)


def size_cell(human: bool = False) -> Column:
    """Size, or ``PRE`` for a directory and ``DELETE`` for a marker."""
    kind = F.col("entry_type")
    return F.when(kind == PREFIX, "PRE").when(kind == DELETE_MARKER, "DELETE").otherwise(
        fmt_size(F.coalesce("size", F.lit(0)), human)
    )


def date_cell(column: str = "last_modified", tz: str | None = None) -> Column:
    return F.coalesce(fmt_ts(F.col(column), tz), F.lit(""))


def listing_cells(show: Display) -> list[Cell]:
    cells = [
        Cell("DATE", _unless_prefix(date_cell(tz=show.tz)), WIDTHS["DATE"]),
        Cell("SIZE", size_cell(show.human), HUMAN_SIZE_WIDTH if show.human else WIDTHS["SIZE"], right=True),
    ]

    def add(name: str, text: Column, right: bool = False) -> None:
        cells.append(Cell(name, text, WIDTHS[name], right))

    if show.storage_class:
        add("STORAGE_CLASS", _for_objects(F.coalesce("storage_class", F.lit("STANDARD"))))
    if show.etag:
        add("ETAG", _for_objects(F.trim(_text("e_tag"), F.lit('"'))))
    if show.checksum_algorithm:
        add("CHECKSUM_ALGORITHM", _for_objects(F.coalesce(F.array_join("checksum_algorithm", ","), F.lit(""))))
    if show.checksum_type:
        add("CHECKSUM_TYPE", _for_objects(_text("checksum_type")))
    if show.versions:
        add("VERSION_ID", _unless_prefix(_text("version_id")))
        if show.is_latest:
            add("IS_LATEST", _unless_prefix(F.when(F.col("is_latest"), "LATEST").otherwise("NOT_LATEST")))
    if show.owner:
        add("OWNER_DISPLAY_NAME", _unless_prefix(escape_ctl(_text("owner_display_name"), show.raw)))
        add("OWNER_ID", _unless_prefix(escape_ctl(_text("owner_id"), show.raw)))
    if show.restore_status:
        add("IS_RESTORE_IN_PROGRESS", _for_objects(_text("is_restore_in_progress")), right=True)
        add("RESTORE_EXPIRY_DATE", _for_objects(_text("restore_expiry_date")))
    return [*cells, Cell("KEY", escape_ctl(show.show_key(), show.raw), None)]


def bucket_cells(show: Display) -> list[Cell]:
    cells = [
        Cell("DATE", date_cell("creation_date", show.tz), WIDTHS["DATE"]),
        Cell("REGION", _text("region"), WIDTHS["REGION"]),
        Cell("BUCKET", escape_ctl(F.col("name"), show.raw), WIDTHS["BUCKET"]),
    ]
    if show.bucket_arn:
        cells.append(Cell("BUCKET_ARN", _text("bucket_arn"), WIDTHS["BUCKET_ARN"]))
    if show.owner:
        for name, column in (("OWNER_DISPLAY_NAME", "owner_display_name"), ("OWNER_ID", "owner_id")):
            cells.append(Cell(name, escape_ctl(_text(column), show.raw), WIDTHS[name]))
    last = cells[-1]
    return [*cells[:-1], Cell(last.name, last.text, None)]


def to_columns(df: DataFrame, show: Display = Display()) -> DataFrame:
    return df.select([cell.text.alias(cell.name) for cell in listing_cells(show)])


def bucket_columns(df: DataFrame, show: Display = Display()) -> DataFrame:
    return df.select([cell.text.alias(cell.name) for cell in bucket_cells(show)])
