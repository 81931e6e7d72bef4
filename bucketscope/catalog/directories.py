"""Virtual directories and views over version tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope import fixtures
from bucketscope.catalog.registry import query
from bucketscope.catalog.scans import plain
from bucketscope.catalog.text import boundary, depth, level_rows, rel, slashes, stamp
from bucketscope.functions.keys import key_depth, prefix_at_depth, relative_key
from bucketscope.operators.hierarchy import (
    discover_prefixes,
    list_level,
    list_recursive,
    objects_only,
)
from bucketscope.operators.prefix_table import PrefixTable
from bucketscope.operators.versions import current_view, history
from bucketscope.plans.listing import listing
from bucketscope.plans.skew import line_numbers
from bucketscope.operators.sorting import listing_order
from bucketscope.session import scratch

ENTRY = ("bucket", "entry_type", "key", "size", "last_modified")


def dated(rows: str) -> str:
    return f"select bucket, entry_type, key, size, {stamp('last_modified', 'last_modified')} from ({rows}) e"


@query(
    "key_depth",
    f"select key, case when starts_with(key, 'data/') and key <> 'data/' then {depth('data/')} end as depth from r",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.versions(spark, sf_dir)
    return rows.select("key", key_depth(F.col("key"), "data/").cast("bigint").alias("depth"))


@query(
    "prefix_at_depth",
    f"""select key, case when starts_with(key, 'da') and {slashes(rel('da'))} >= 2 then {boundary('da', 2)} end
as boundary from r""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.versions(spark, sf_dir)
    return rows.select("key", prefix_at_depth(F.col("key"), "da", 2).alias("boundary"))


@query("list_level", dated(level_rows("objects", "data/", 1)), ("objects",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(list_level(fixtures.objects(spark, sf_dir), "data/"), *ENTRY)


@query("list_level_root", dated(level_rows("objects", "", 1)), ("objects",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(list_level(fixtures.objects(spark, sf_dir)), *ENTRY)


@query("list_recursive", dated("select * from objects where starts_with(key, 'data/')"), ("objects",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(list_recursive(fixtures.objects(spark, sf_dir), "data/"), *ENTRY)


@query("list_depth_rollup", dated(level_rows("objects", "data/", 2)), ("objects",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(list_recursive(fixtures.objects(spark, sf_dir), "data/", max_depth=2), *ENTRY)


@query("list_depth_object", dated(level_rows("objects", "data/", 2, "object")), ("objects",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(list_recursive(fixtures.objects(spark, sf_dir), "data/", max_depth=2, marker="object"), *ENTRY)


@query(
    "objects_only",
    dated("select * from (" + level_rows("objects", "", 1) + ") l where entry_type <> 'PREFIX'"),
    ("objects",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(objects_only(list_level(fixtures.objects(spark, sf_dir))), *ENTRY)


@query(
    "relative_key",
    """select key, case when not starts_with(key, 'data/a') then key
  when substr(key, 7) in ('', '/') then key
  when substr(key, 7) like '/%' then substr(key, 8) else substr(key, 7) end as shown from r""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.versions(spark, sf_dir)
    return rows.select("key", relative_key(F.col("key"), "data/a").alias("shown"))


DISCOVERED = f"""select bucket, n as level, regexp_extract(key, case n when 1 then '^(([^/]*/){{1}})' when 2 then '^(([^/]*/){{2}})'
  else '^(([^/]*/){{3}})' end, 1) as prefix, count(*) as object_count, cast(sum(size) as bigint) as total_size
from objects join (select 1 as n union all select 2 union all select 3) l on {slashes('key')} >= n group by 1, 2, 3"""


@query("discover_prefixes", DISCOVERED, ("objects",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover_prefixes(fixtures.objects(spark, sf_dir), depth=3)


@query(
    "current_view",
    f"select bucket, key, size, {stamp('last_modified', 'last_modified')}, e_tag, storage_class from objects",
    ("objects",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = current_view(fixtures.versions(spark, sf_dir))
    return plain(view, "bucket", "key", "size", "last_modified", "e_tag", "storage_class")


@query(
    "version_level_hidden_markers",
    "select bucket, entry_type, key, size, version_id, is_latest from versions where starts_with(key, 'data/r/') "
    f"and {slashes(rel('data/r/'))} < 1 and entry_type <> 'DELETE_MARKER' union all "
    f"select distinct bucket, 'PREFIX', {boundary('data/r/', 1)}, cast(0 as bigint), cast(null as varchar), "
    f"cast(null as boolean) from versions where starts_with(key, 'data/r/') and {slashes(rel('data/r/'))} >= 1",
    ("versions",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(fixtures.versions(spark, sf_dir), prefix="data/r/", versions=True, hide_markers=True, sort=None)
    return rows.select("bucket", "entry_type", "key", "size", "version_id", "is_latest")


HISTORY = """select bucket, key, version_id, is_latest, row_number() over (
  order by key, last_modified, bucket, version_id) as pos from versions"""


@query("history", HISTORY, ("versions",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.versions(spark, sf_dir).select("bucket", "entry_type", "key", "last_modified", "version_id", "is_latest")
    numbered = line_numbers(rows, [k.order() for k in listing_order(["key"], versions=True)])
    return numbered.select("bucket", "key", "version_id", "is_latest", "pos")


@query("history_rows", f"select bucket, key, version_id, {stamp('last_modified', 'last_modified')} from versions", ("versions",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(history(fixtures.versions(spark, sf_dir)), "bucket", "key", "version_id", "last_modified")


@query("discover_prefixes_by_deltas", DISCOVERED, ("objects",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the objects and some that go again, then the other half: as a table kept over two inventories."""
    rows = fixtures.objects(spark, sf_dir)
    late = F.pmod(F.xxhash64("bucket", "key"), F.lit(2)) == 1
    passing = rows.where("size % 5 = 0").withColumn("key", F.concat(F.lit("gone/"), F.col("key")))
    table = PrefixTable(spark, scratch(spark, "prefix-table"), depth=3)
    table.apply("first", rows.where(~late).unionByName(passing))
    table.apply("second", rows.where(late), passing)
    return table.discover()
