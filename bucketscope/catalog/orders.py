"""Sort orders and totals. Each sort is checked by the line number it gives every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope import fixtures
from bucketscope.catalog.registry import query
from bucketscope.catalog.scans import plain
from bucketscope.catalog.text import boundary, level_rows, slashes
from bucketscope.functions.keys import prefix_at_depth
from bucketscope.operators.sorting import bucket_order, listing_order, sort_listing
from bucketscope.operators.summary import summarize, with_summary
from bucketscope.plans.listing import listing
from bucketscope.plans.skew import line_numbers

TOTALS = """count(*) filter (where entry_type = 'OBJECT') as total_objects,
cast(coalesce(sum(size) filter (where entry_type = 'OBJECT'), 0) as bigint) as total_size,
count(*) filter (where entry_type = 'DELETE_MARKER') as total_delete_markers"""


TIES = "bucket asc nulls first, key asc nulls first, version_id asc nulls first, entry_type asc"
#: name -> (fields, reverse, versions, SQL order)
SORTS = {
    "sort_key": (["key"], False, False, "key asc"),
    "sort_size": (["size"], False, False, "case when entry_type = 'OBJECT' then size else 0 end asc"),
    "sort_date": (["date"], False, False, "last_modified asc nulls last"),
    "sort_size_then_key": (["size", "key"], False, False, "case when entry_type = 'OBJECT' then size else 0 end asc, key asc"),
    "sort_date_reverse": (["date"], True, False, "last_modified desc nulls first"),
    "sort_key_reverse": (["key"], True, False, "key desc"),
    "sort_date_key_reverse": (["date", "key"], True, False, "last_modified desc nulls first, key desc"),
    "sort_versions_default": (["key"], False, True, "key asc, last_modified asc nulls last"),
    "sort_versions_size": (
        ["size"], False, True, "case when entry_type = 'OBJECT' then size else 0 end asc, last_modified asc nulls last",
    ),
}


def _register_sort(name: str, fields: list[str], reverse: bool, versions: bool, order: str) -> None:
    sql = f"""select bucket, entry_type, key, size, version_id, row_number() over (order by {order}, {TIES}) as pos
from entries e"""

    @query(name, sql, ("entries",))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = fixtures.entries(spark, sf_dir)
        rows = rows.select("bucket", "entry_type", "key", "size", "version_id", "last_modified")
        numbered = line_numbers(rows, [k.order() for k in listing_order(fields, reverse, versions)])
        return numbered.select("bucket", "entry_type", "key", "size", "version_id", "pos")


for _name, _spec in SORTS.items():
    _register_sort(_name, *_spec)


@query("sort_listing", f"select bucket, entry_type, key, size, version_id from entries e", ("entries",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_listing(fixtures.entries(spark, sf_dir), ["key"]).select("bucket", "entry_type", "key", "size", "version_id")


@query(
    "listing_unsorted",
    "select bucket, entry_type, key, size from (" + level_rows("objects", "data/", 2)
    + ") l where entry_type = 'PREFIX' or size >= 0",
    ("objects",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(fixtures.objects(spark, sf_dir), prefix="data/", max_depth=2, sort=None)
    return rows.select("bucket", "entry_type", "key", "size")


#: name -> (fields, reverse, SQL order)
BUCKET_SORTS = {
    "sort_buckets": (["bucket"], False, "name asc"),
    "sort_buckets_date": (["date"], False, "creation_date asc nulls first"),
    "sort_buckets_region_date": (["region", "date"], False, "region asc nulls first, creation_date asc nulls first"),
    "sort_buckets_region_reverse": (["region"], True, "region desc nulls last"),
}


def _register_bucket_sort(name: str, fields: list[str], reverse: bool, order: str) -> None:
    @query(name, f"select name, region, row_number() over (order by {order}, name asc) as pos from buckets", ("buckets",))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        order_by = [k.order() for k in bucket_order(fields, reverse)]
        return line_numbers(fixtures.buckets(spark, sf_dir), order_by).select("name", "region", "pos")


for _name, _bucket_spec in BUCKET_SORTS.items():
    _register_bucket_sort(_name, *_bucket_spec)


@query("summarize", f"select {TOTALS} from entries e", ("entries",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(fixtures.entries(spark, sf_dir))


@query("summarize_by_bucket", f"select bucket, {TOTALS} from r group by bucket", ("r",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(fixtures.versions(spark, sf_dir), by=["bucket"])


@query(
    "summarize_by_prefix",
    f"""select bucket, prefix, {TOTALS} from (select *, case when {slashes('key')} >= 2 then {boundary('', 2)} end as prefix
from r) p group by bucket, prefix""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.versions(spark, sf_dir)
    return summarize(rows, by=["bucket", prefix_at_depth(F.col("key"), "", 2).alias("prefix")])


@query(
    "with_summary",
    f"""select 0 as section, bucket, entry_type, key, size, cast(null as bigint) as total_objects,
cast(null as bigint) as total_size, cast(null as bigint) as total_delete_markers from entries e
union all select 1, null, null, null, null, t.* from (select {TOTALS} from entries e) t""",
    ("entries",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("section", "bucket", "entry_type", "key", "size", "total_objects", "total_size", "total_delete_markers")
    return plain(with_summary(fixtures.entries(spark, sf_dir)), *names)
