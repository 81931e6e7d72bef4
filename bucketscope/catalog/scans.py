"""Scans, targets and sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bucketscope import fixtures
from bucketscope.catalog.registry import query
from bucketscope.catalog.text import stamp
from bucketscope.functions.scalars import fmt_ts
from bucketscope.operators.filters import FilterConfig
from bucketscope.operators.hierarchy import repartition_by_prefix
from bucketscope.plans.display import Display
from bucketscope.plans.writer import write_listing
from bucketscope.session import ROWS_PER_TASK, scratch, small_tasks, stored
from bucketscope.sources import inventory, manifest, ndjson, tree
from bucketscope.sources.targets import format_target, parse_target, under, under_targets


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """The columns in forms that compare across engines: dates as text, lists joined."""
    shown: list[Column] = []
    for name in columns or df.columns:
        kind = df.schema[name].dataType.typeName()
        if kind == "timestamp":
            shown.append(fmt_ts(F.col(name)).alias(name))
        elif kind == "array":
            shown.append(F.array_join(name, ",").alias("checksum_csv"))
        else:
            shown.append(F.col(name))
    return df.select(shown)


STORED = f"""bucket, entry_type, key, size, {stamp('last_modified', 'last_modified')}, e_tag, storage_class, checksum_csv,
checksum_type, owner_display_name, owner_id, is_restore_in_progress, restore_expiry_date"""
UNVERSIONED = "cast(null as varchar) as version_id, cast(null as boolean) as is_latest"
BUCKETS = f"name, {stamp('creation_date', 'creation_date')}, region, bucket_arn"


@query("scan_objects", f"select {STORED}, {UNVERSIONED} from objects", ("objects",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(inventory.objects(fixtures.objects(spark, sf_dir)))


@query("scan_versions", f"select {STORED}, version_id, is_latest from versions", ("versions",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(inventory.versions(fixtures.versions(spark, sf_dir)))


def _register_form(form: str) -> None:
    @query(f"read_inventory_{form}", f"select {STORED}, version_id, is_latest from versions", ("versions",))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, form)
        rows = fixtures.versions(spark, sf_dir)
        if form == "csv":
            rows = rows.withColumn("checksum_algorithm", F.nullif(F.array_join("checksum_algorithm", ","), F.lit("")))
            rows.write.csv(path, header=True, escape='"', emptyValue='""', compression="gzip")
        elif form == "json":
            rows.write.json(path, compression="gzip")
        else:
            rows.write.format(form).save(path)
        return plain(inventory.read_inventory(spark, path, form, line_breaks=True))


for _form in ("parquet", "orc", "json", "csv"):
    _register_form(_form)


@query("scan_buckets", f"select {BUCKETS}, owner_display_name, owner_id from buckets", ("buckets",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(inventory.buckets(fixtures.buckets(spark, sf_dir)))


@query(
    "scan_directory_buckets",
    f"""select {BUCKETS}, cast(null as varchar) as owner_display_name, cast(null as varchar) as owner_id
from buckets where name like '%--x-s3'""",
    ("buckets",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(inventory.directory_buckets(fixtures.buckets(spark, sf_dir)))


@query(
    "filter_bucket_name_prefix",
    f"select {BUCKETS}, owner_display_name, owner_id from buckets where name like 'bucket-1%'",
    ("buckets",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(inventory.buckets(fixtures.buckets(spark, sf_dir), name_prefix="bucket-1"))


@query(
    "parse_target",
    """select url, regexp_extract(target, '^s3://([^/]+)', 1) as bucket,
nullif(regexp_extract(target, '^s3://[^/]+/(.*)$', 1), '') as prefix, target as shown from uris""",
    ("uris",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = fixtures.uris(spark, sf_dir).withColumn("at", parse_target(F.col("target")))
    shown = format_target(F.col("at.bucket"), F.col("at.prefix"))
    return parsed.select("url", "at.bucket", "at.prefix", shown.alias("shown"))


#: Each page as a target of four kinds: valid, without a prefix, without a bucket, and as it is (not a target).
CANDIDATES = """select url, n, case n when 0 then 's3://' || bucket || '/' || url when 1 then 's3://' || bucket
when 2 then 's3:///' || url else url end as target
from (select url, unnest([0, 1, 2, 3]) as n, 'bucket-' || cast(page_id % 7 as varchar) as bucket from pages) c"""


@query(
    "parse_target_rejects",
    f"""select url, n, regexp_matches(target, '^s3://[^/]+') as is_target,
nullif(regexp_extract(target, '^s3://([^/]+)', 1), '') as bucket from ({CANDIDATES}) t""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixtures.table(spark, sf_dir, "pages")
    kinds = pages.select("url", F.explode(F.array(*[F.lit(n) for n in range(4)])).alias("n"), (F.col("page_id") % 7).alias("b"))
    bucket = F.concat(F.lit("bucket-"), F.col("b").cast("string"))
    target = (
        F.when(F.col("n") == 0, F.concat(F.lit("s3://"), bucket, F.lit("/"), F.col("url")))
        .when(F.col("n") == 1, F.concat(F.lit("s3://"), bucket))
        .when(F.col("n") == 2, F.concat(F.lit("s3:///"), F.col("url")))
        .otherwise(F.col("url"))
    )
    parsed = parse_target(target, on_error="null")
    return kinds.select("url", "n", parsed.isNotNull().alias("is_target"), parsed["bucket"].alias("bucket"))


@query(
    "scan_prefix",
    "select bucket, key, size from objects where starts_with(key, 'data/a')",
    ("objects",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return under(fixtures.objects(spark, sf_dir), "data/a").select("bucket", "key", "size")


MANY_TARGETS = """select o.bucket, coalesce(t.prefix, '') as target_prefix, o.key, o.size
from objects o join targets t on o.bucket = t.bucket and starts_with(o.key, coalesce(t.prefix, ''))"""


@query("scan_many_targets", MANY_TARGETS, ("objects", "targets"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = under_targets(fixtures.objects(spark, sf_dir), fixtures.targets(spark, sf_dir))
    return found.select("bucket", "target_prefix", "key", "size")


@query("scan_many_targets_shuffled", MANY_TARGETS, ("objects", "targets"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = under_targets(fixtures.objects(spark, sf_dir), fixtures.targets(spark, sf_dir), broadcast_bytes=0)
    return found.select("bucket", "target_prefix", "key", "size")


USABLE = "key is not null and last_modified is not null"
CLAMPED = "greatest(coalesce(size, 0), 0) as size"


@query(
    "normalize_objects",
    f"""select bucket, 'OBJECT' as entry_type, key, {CLAMPED}, {stamp('last_modified', 'last_modified')},
coalesce(e_tag, '') as e_tag, '' as checksum_csv, owner_id, {UNVERSIONED}
from raw_rows where {USABLE} and not is_delete_marker""",
    ("raw_rows",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.raw_rows(spark, sf_dir).filter("not is_delete_marker")
    return plain(inventory.normalize_objects(raw), *NORMALIZED)


NORMALIZED = (
    "bucket", "entry_type", "key", "size", "last_modified", "e_tag", "checksum_algorithm", "owner_id", "version_id",
    "is_latest",
)
VERSIONED = "coalesce(version_id, 'null') as version_id, coalesce(is_latest, false) as is_latest"


@query(
    "normalize_versions",
    f"""select bucket, 'OBJECT' as entry_type, key, {CLAMPED}, {stamp('last_modified', 'last_modified')},
coalesce(e_tag, '') as e_tag, '' as checksum_csv, owner_id, {VERSIONED}
from raw_rows where {USABLE} and not is_delete_marker""",
    ("raw_rows",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.raw_rows(spark, sf_dir).filter("not is_delete_marker")
    return plain(inventory.normalize_versions(raw), *NORMALIZED)


@query(
    "normalize_delete_markers",
    f"""select bucket, 'DELETE_MARKER' as entry_type, key, cast(0 as bigint) as size,
{stamp('last_modified', 'last_modified')}, '' as e_tag, '' as checksum_csv, owner_id, {VERSIONED}
from raw_rows where {USABLE} and is_delete_marker""",
    ("raw_rows",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.raw_rows(spark, sf_dir).filter("is_delete_marker")
    return plain(inventory.normalize_delete_markers(raw), *NORMALIZED)


@query(
    "optional_attributes",
    """select bucket, key, owner_display_name, owner_id, cast(null as boolean) as is_restore_in_progress,
cast(null as varchar) as restore_expiry_date from objects""",
    ("objects",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = inventory.with_optional(fixtures.objects(spark, sf_dir), owner=True, restore=False)
    names = ("owner_display_name", "owner_id", "is_restore_in_progress", "restore_expiry_date")
    return kept.select("bucket", "key", *names)


@query(
    "read_listing_json",
    f"""select entry_type, key, size, {stamp('last_modified', 'last_modified')}, e_tag, storage_class, checksum_csv,
checksum_type, owner_display_name, owner_id, is_restore_in_progress,
case when is_restore_in_progress is not null then restore_expiry_date end as restore_expiry_date, version_id, is_latest
from (select * exclude (checksum_csv), case when entry_type = 'OBJECT' then checksum_csv end as checksum_csv
from versions) v""",
    ("versions",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "listing")
    rows = fixtures.versions(spark, sf_dir)
    write_listing(rows, path, "json", Display(versions=True), sort=None, summary=True, compression="gzip")
    return plain(ndjson.read_listing_json(spark, path).drop("bucket"))


@query(
    "read_summary_json",
    """select count(*) filter (where entry_type = 'OBJECT') as "TotalObjects", cast(sum(size) as bigint) as "TotalSize",
count(*) filter (where entry_type = 'DELETE_MARKER') as "TotalDeleteMarkers" from r""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "listing")
    write_listing(
        fixtures.versions(spark, sf_dir), path, "json", Display(versions=True),
        sort=None, summary=True, compression="gzip",
    )
    return ndjson.read_summary_json(spark, path)


@query(
    "scan_chosen_files",
    """select bucket, entry_type, key, size, version_id from r where bucket = 'bkt-2' and starts_with(key, 'data/n/199')
and (entry_type = 'DELETE_MARKER' or (size >= 2048 and (storage_class is null or storage_class in ('STANDARD', 'GLACIER'))))
and last_modified >= timestamp '1996-01-01'""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = FilterConfig(larger_size="2KiB", storage_class=("STANDARD", "GLACIER"), mtime_after=dt.datetime(1996, 1, 1))
    found = manifest.scan(spark, fixtures.indexed_inventory_path(spark, sf_dir), "bkt-2", "data/n/199", asked)
    return found.select("bucket", "entry_type", "key", "size", "version_id")


SLASHES = "cast(length(key) - length(replace(key, '/', '')) as int)"


@query("live_tree", f"select key, size, 'OBJECT' as entry_type, {SLASHES} + 1 as key_depth from files", ("files",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # small budgets, so that the tree takes several passes
    listed = tree.walk_tree(spark, fixtures.tree_path(spark, sf_dir), tasks=8, first_budget=200, flat_files=1000)
    return listed.select("key", "size", "entry_type", "key_depth")


@query(
    "live_tree_levels",
    f"""select key, size, 'OBJECT' as entry_type from files where {SLASHES} < 4 and starts_with(key, 'bkt-1/da')
union all select distinct regexp_extract(key, '^([^/]*/){{4}}', 0), 0, 'PREFIX' from files
where {SLASHES} >= 4 and starts_with(key, 'bkt-1/da')""",
    ("files",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = tree.walk_tree(spark, fixtures.tree_path(spark, sf_dir), "bkt-1/da", max_depth=3, tasks=8)
    return listed.select("key", "size", "entry_type")


@query(
    "live_tree_filtered",
    f"select key, size from files where starts_with(key, 'bkt-1/data/r/199') and {SLASHES} <= 5 and key >= 'bkt-1/data/r/1994/' and size > 14",
    ("files",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = tree.object_tree(spark, fixtures.tree_path(spark, sf_dir), tasks=8)
    asked = listed.where("key like 'bkt-1/data/r/199%' and key_depth <= 6 and key >= 'bkt-1/data/r/1994/' and size > 14")
    return asked.select("key", "size")


@query(
    "repartition_by_prefix",
    "select bucket, key, size, version_id, true as several, false as overlaps from r",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with whether its partition's range of keys meets that of another, and whether there are several at all."""
    by = ["bucket", "key", "version_id"]
    rows = fixtures.versions(spark, sf_dir).select("bucket", "key", "size", "version_id")
    with small_tasks(spark, rows.count()):
        ordered = repartition_by_prefix(rows, 8, ROWS_PER_TASK).sortWithinPartitions(*by)
        dealt = stored(ordered.withColumn("slot", F.monotonically_increasing_id()), "dealt")
    part = F.shiftright("slot", 33).alias("part")
    # numbers find the first and the last row of a partition, so that no task puts its keys in order again
    ends = dealt.groupBy(part).agg(F.max("slot").alias("last"))
    place = F.struct(*by)
    found = dealt.select(part, "slot", place.alias("place")).join(F.broadcast(ends), "part")
    ends_of = found.where((F.col("slot") == F.col("last")) | (F.col("slot").bitwiseAND(F.lit((1 << 33) - 1)) == 0))
    # a row per partition
    edges = ends_of.groupBy("part").agg(F.min("place").alias("least"), F.max("place").alias("most"))
    along = Window.orderBy("least")
    met = F.coalesce(F.lag("most").over(along) >= F.col("least"), F.lit(False)) | F.coalesce(F.lead("least").over(along) <= F.col("most"), F.lit(False))
    several = F.count(F.lit(1)).over(Window.partitionBy()) > 1
    ranges = edges.select("part", several.alias("several"), met.alias("overlaps"))
    return dealt.select("bucket", "key", "size", "version_id", part).join(F.broadcast(ranges), "part").drop("part")
