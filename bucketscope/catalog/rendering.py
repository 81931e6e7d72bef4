"""Value formatting, display columns and rendered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope import fixtures
from bucketscope.catalog.orders import TIES, TOTALS
from bucketscope.catalog.registry import query
from bucketscope.catalog.text import escaped, human, padded, stamp
from bucketscope.functions.scalars import escape_ctl, fmt_size, fmt_size_split, fmt_ts
from bucketscope.operators.summary import summarize
from bucketscope.plans.display import WIDTHS, Display, bucket_columns, size_cell, to_columns
from bucketscope.plans.render import (
    buckets_to_json,
    buckets_to_text,
    summary_json,
    summary_text,
    to_aligned,
    to_json,
    to_lines,
    to_tsv,
)
from bucketscope.plans.writer import read_lines, read_with_summary, write_buckets, write_listing, write_with_summary
from bucketscope.session import scratch
from bucketscope.sources.ndjson import RECORD_SCHEMA


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.versions(spark, sf_dir)


DATE = f"case when entry_type = 'PREFIX' then '' else {stamp('last_modified')} end"
SIZE = "case entry_type when 'PREFIX' then 'PRE' when 'DELETE_MARKER' then 'DELETE' else cast(size as varchar) end"


def _stored(text: str) -> str:
    return f"case when entry_type = 'OBJECT' then {text} else '' end"


def _not_prefix(text: str) -> str:
    return f"case when entry_type = 'PREFIX' then '' else {text} end"


#: display column -> SQL text
CELLS = {
    "DATE": DATE,
    "SIZE": SIZE,
    "STORAGE_CLASS": _stored("coalesce(storage_class, 'STANDARD')"),
    "ETAG": _stored("trim(e_tag, '\"')"),
    "CHECKSUM_ALGORITHM": _stored("checksum_csv"),
    "CHECKSUM_TYPE": _stored("coalesce(checksum_type, '')"),
    "VERSION_ID": _not_prefix("version_id"),
    "IS_LATEST": _not_prefix("case when is_latest then 'LATEST' else 'NOT_LATEST' end"),
    "OWNER_DISPLAY_NAME": _not_prefix(escaped("coalesce(owner_display_name, '')")),
    "OWNER_ID": _not_prefix("coalesce(owner_id, '')"),
    "IS_RESTORE_IN_PROGRESS": _stored("coalesce(cast(is_restore_in_progress as varchar), '')"),
    "RESTORE_EXPIRY_DATE": _stored("coalesce(restore_expiry_date, '')"),
    "KEY": escaped("key"),
}
RIGHT = ("SIZE", "IS_RESTORE_IN_PROGRESS")
EVERYTHING = Display(
    storage_class=True, etag=True, checksum_algorithm=True, checksum_type=True, versions=True, is_latest=True,
    owner=True, restore_status=True,
)


def _cells(*names: str) -> str:
    return ", ".join(f'{CELLS[n]} as "{n}"' for n in names)


@query("timestamp_utc", f"select version_id, {stamp('last_modified', 'shown')} from r", ("r",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("version_id", fmt_ts(F.col("last_modified")).alias("shown"))


@query(
    "timestamp_zone",
    """select version_id, concat(strftime(last_modified + interval 9 hour, '%Y-%m-%dT%H:%M:%S'), '+09:00') as shown,
concat(strftime(last_modified - interval 210 minute, '%Y-%m-%dT%H:%M:%S'), '-03:30') as west from r""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("last_modified")
    return _flat(spark, sf_dir).select(
        "version_id", fmt_ts(at, "Asia/Tokyo").alias("shown"), fmt_ts(at, "-03:30").alias("west")
    )


@query("human_size", f"select version_id, {human('(size * size * 37)')} as shown from r", ("r",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = F.col("size") * F.col("size") * 37
    return _flat(spark, sf_dir).select("version_id", fmt_size(large, human=True).alias("shown"))


@query(
    "human_size_split",
    f"""select version_id, case when size < 1024 then cast(size as varchar) else split_part({human('size', ' ')}, ' ', 1) end
as number, case when size < 1024 then 'bytes' else split_part({human('size', ' ')}, ' ', 2) end as unit from r""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("version_id", fmt_size_split(F.col("size")).alias("s")).select("version_id", "s.*")


@query("escape_control", f"select version_id, {escaped('key')} as shown from r", ("r",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("version_id", escape_ctl(F.col("key")).alias("shown"))


@query("size_cell", f"select bucket, key, version_id, {SIZE} as shown from entries e", ("entries",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.entries(spark, sf_dir).select("bucket", "key", "version_id", size_cell().alias("shown"))


#: name -> (display, columns shown)
SHOWN = {
    "show_storage_class": (Display(storage_class=True), ("STORAGE_CLASS",)),
    "show_etag": (Display(etag=True), ("ETAG",)),
    "show_checksum_algorithm": (Display(checksum_algorithm=True), ("CHECKSUM_ALGORITHM",)),
    "show_checksum_type": (Display(checksum_type=True), ("CHECKSUM_TYPE",)),
    "show_version_id": (Display(versions=True), ("VERSION_ID",)),
    "show_is_latest": (Display(versions=True, is_latest=True), ("VERSION_ID", "IS_LATEST")),
    "show_owner": (Display(owner=True), ("OWNER_DISPLAY_NAME", "OWNER_ID")),
    "show_restore_status": (Display(restore_status=True), ("IS_RESTORE_IN_PROGRESS", "RESTORE_EXPIRY_DATE")),
    "to_columns": (EVERYTHING, tuple(n for n in CELLS if n not in ("DATE", "SIZE", "KEY"))),
}


def _register_shown(name: str, show: Display, columns: tuple[str, ...]) -> None:
    sql = f"select {_cells('DATE', 'SIZE', *columns, 'KEY')} from entries e"

    @query(name, sql, ("entries",))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return to_columns(fixtures.entries(spark, sf_dir), show)


for _name, (_show, _columns) in SHOWN.items():
    _register_shown(_name, _show, _columns)

B_DATE = f"coalesce({stamp('creation_date')}, '')"


@query(
    "bucket_columns",
    f"""select {B_DATE} as "DATE", coalesce(region, '') as "REGION", name as "BUCKET", bucket_arn as "BUCKET_ARN",
owner_display_name as "OWNER_DISPLAY_NAME", owner_id as "OWNER_ID" from buckets""",
    ("buckets",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_columns(fixtures.buckets(spark, sf_dir), Display(bucket_arn=True, owner=True))


def _tsv(*names: str) -> str:
    return "concat_ws(chr(9), " + ", ".join(CELLS[n] for n in names) + ")"


def _aligned(*names: str) -> str:
    cells = [padded(f"({CELLS[n]})", WIDTHS[n], "l" if n in RIGHT else "r") for n in names[:-1]]
    return "concat_ws('  ', " + ", ".join([*cells, CELLS[names[-1]]]) + ")"


@query("to_tsv", f"select {_tsv(*CELLS)} as value from entries e", ("entries",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_tsv(fixtures.entries(spark, sf_dir), EVERYTHING)


@query("to_aligned", f"select {_aligned(*CELLS)} as value from entries e", ("entries",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_aligned(fixtures.entries(spark, sf_dir), EVERYTHING)


@query(
    "to_lines",
    f"select {escaped('case when starts_with(key, ' + chr(39) + 'data/' + chr(39) + ') then substr(key, 6) else key end')} "
    f"as value from entries e",
    ("entries",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_lines(fixtures.entries(spark, sf_dir), Display(relative=True, prefix="data/"))


JSON_FIELDS = f"""case when entry_type = 'PREFIX' then 1
  when entry_type = 'DELETE_MARKER' then 5 + case when owner_display_name is null and owner_id is null then 0 else 1 end
  else 6 + case when checksum_csv = '' then 0 else 1 end + case when checksum_type is null then 0 else 1 end
    + case when storage_class is null then 0 else 1 end
    + case when owner_display_name is null and owner_id is null then 0 else 1 end
    + case when is_restore_in_progress is null then 0 else 1 end end as n_fields"""


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.select(F.size(F.json_object_keys("value")).alias("n_fields"), F.from_json("value", RECORD_SCHEMA).alias("j"))


@query(
    "to_json",
    f"""select {JSON_FIELDS}, case when entry_type <> 'PREFIX' then key end as key,
case when entry_type = 'PREFIX' then key end as prefix, {stamp('last_modified', 'last_modified')},
case when entry_type = 'OBJECT' then e_tag end as e_tag,
case when entry_type = 'OBJECT' then nullif(checksum_csv, '') end as checksum_csv, checksum_type,
case when entry_type = 'OBJECT' then size end as size, storage_class, version_id, is_latest,
case when entry_type = 'DELETE_MARKER' then true end as marker, owner_display_name, owner_id, is_restore_in_progress,
restore_expiry_date from entries e""",
    ("entries",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    def field(path: str, name: str) -> Column:
        return F.col(f"j.{path}").alias(name)

    return _parsed(to_json(fixtures.entries(spark, sf_dir), Display(versions=True))).select(
        F.col("n_fields").cast("int"),
        field("Key", "key"),
        field("Prefix", "prefix"),
        field("LastModified", "last_modified"),
        field("ETag", "e_tag"),
        F.array_join("j.ChecksumAlgorithm", ",").alias("checksum_csv"),
        field("ChecksumType", "checksum_type"),
        field("Size", "size"),
        field("StorageClass", "storage_class"),
        field("VersionId", "version_id"),
        field("IsLatest", "is_latest"),
        field("DeleteMarker", "marker"),
        field("Owner.DisplayName", "owner_display_name"),
        field("Owner.ID", "owner_id"),
        field("RestoreStatus.IsRestoreInProgress", "is_restore_in_progress"),
        field("RestoreStatus.RestoreExpiryDate", "restore_expiry_date"),
    )


STATS = """select count(*) filter (where entry_type = 'OBJECT') as n, cast(sum(size) as bigint) as s,
count(*) filter (where entry_type = 'DELETE_MARKER') as m from r"""


@query(
    "summary_text",
    f"""select concat(chr(10), 'Total:', chr(9), n, chr(9), 'objects', chr(9), s, chr(9), 'bytes', chr(9), m, chr(9),
'delete markers') as value from ({STATS}) t
union all select concat(chr(10), 'Total: ', n, ' objects ', {human('s', ' ')}) from ({STATS}) t""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = summarize(_flat(spark, sf_dir))
    return summary_text(stats, "tsv", Display(versions=True)).union(summary_text(stats, "aligned", Display(human=True)))


@query(
    "summary_json",
    f"""select concat('{{"Summary":{{"TotalObjects":', n, ',"TotalSize":', s, ',"TotalDeleteMarkers":', m, '}}}}') as value
from ({STATS}) t""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_json(summarize(_flat(spark, sf_dir)), versions=True)


B_CELLS = {"DATE": B_DATE, "REGION": "coalesce(region, '')", "BUCKET": "name", "BUCKET_ARN": "bucket_arn"}
B_ALIGNED = ", ".join([padded(f"({t})", WIDTHS[n]) for n, t in B_CELLS.items()][:-1] + [B_CELLS["BUCKET_ARN"]])


@query("buckets_to_tsv", f"select concat_ws(chr(9), {', '.join(B_CELLS.values())}) as value from buckets", ("buckets",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets_to_text(fixtures.buckets(spark, sf_dir), "tsv", Display(bucket_arn=True))


@query("buckets_to_aligned", f"select concat_ws('  ', {B_ALIGNED}) as value from buckets", ("buckets",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets_to_text(fixtures.buckets(spark, sf_dir), "aligned", Display(bucket_arn=True))


@query("buckets_to_lines", "select name as value from buckets", ("buckets",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets_to_text(fixtures.buckets(spark, sf_dir), "lines")


@query(
    "buckets_to_json",
    f"""select 3 + case when creation_date is null then 0 else 1 end + case when region is null then 0 else 1 end as n_fields,
name, {stamp('creation_date', 'creation_date')}, region, bucket_arn, owner_display_name, owner_id from buckets""",
    ("buckets",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = "Name string, CreationDate string, BucketRegion string, BucketArn string, Owner struct<DisplayName: string, ID: string>"
    lines = buckets_to_json(fixtures.buckets(spark, sf_dir), show_owner=True)
    parsed = lines.select(F.size(F.json_object_keys("value")).alias("n_fields"), F.from_json("value", shape).alias("j"))
    return parsed.select(
        "n_fields",
        F.col("j.Name").alias("name"),
        F.col("j.CreationDate").alias("creation_date"),
        F.col("j.BucketRegion").alias("region"),
        F.col("j.BucketArn").alias("bucket_arn"),
        F.col("j.Owner.DisplayName").alias("owner_display_name"),
        F.col("j.Owner.ID").alias("owner_id"),
    )


@query(
    "write_listing",
    f"""select row_number() over (order by section, key asc, {TIES}) as pos, value from (
select 0 as section, concat_ws(chr(9), 'DATE', 'SIZE', 'KEY') as value, null as bucket, null as key, null as version_id, null as entry_type
union all select 1, concat_ws(chr(9), {DATE}, {SIZE}, {escaped('key')}), bucket, key, version_id, entry_type from entries e
union all select 2, '', null, null, null, null
union all select 3, concat('Total:', chr(9), n, chr(9), 'objects', chr(9), s, chr(9), 'bytes'), null, null, null, null
from ({STATS}) t) l""",
    ("entries",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "written")
    write_listing(fixtures.entries(spark, sf_dir), path, "tsv", with_header=True, summary=True)
    return read_lines(spark, path)


@query(
    "write_with_summary",
    f"""select bucket, entry_type, key, size, version_id, 0 as section, null as total_objects, null as total_size,
null as total_delete_markers from entries e union all select null, null, null, null, null, 1, {TOTALS} from entries e""",
    ("entries",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "totalled")
    rows = fixtures.entries(spark, sf_dir).select("bucket", "entry_type", "key", "size", "version_id")
    write_with_summary(rows, path)
    return read_with_summary(spark, path)


@query(
    "write_buckets",
    f"""select row_number() over (order by section, creation_date asc nulls first, name) as pos, value from (
select 0 as section, null as creation_date, null as name, concat_ws(chr(9), 'DATE', 'REGION', 'BUCKET') as value
union all select 1, creation_date, name, concat_ws(chr(9), {', '.join(list(B_CELLS.values())[:3])}) from buckets b) l""",
    ("buckets",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "buckets")
    write_buckets(fixtures.buckets(spark, sf_dir), path, "tsv", sort=["date"], with_header=True)
    return read_lines(spark, path)
