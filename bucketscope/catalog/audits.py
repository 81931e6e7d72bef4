"""Streaming listings, request estimates, page audits and reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bucketscope import fixtures
from bucketscope.catalog.filters import ALL, EVERY_STEP
from bucketscope.catalog.orders import TOTALS
from bucketscope.catalog.registry import query
from bucketscope.catalog.text import boundary, level_rows, rel, slashes
from bucketscope.operators.audit import audit_pages, differing_prefixes, estimate_requests, reconcile, reconcile_by_prefix
from bucketscope.operators.filters import FilterConfig
from bucketscope.operators.hierarchy import list_level
from bucketscope.schema import LISTING_SCHEMA
from bucketscope.session import scratch
from bucketscope.sources.layout import data_files
from bucketscope.streaming.listing import (
    append_to,
    emit_prefixes,
    read_prefixes,
    read_stream,
    read_totals,
    refresh_totals,
    stream_listing,
    stream_prefixes,
    stream_summary,
)

#: Micro-batches that a larger inventory is read in.
BATCHES = 8


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory's files as a stream, a few per micro-batch: four, or so many that there are about ``BATCHES``."""
    path = fixtures.inventory_path(spark, sf_dir)
    files = data_files(spark, path).count()
    return read_stream(spark, path, LISTING_SCHEMA, files_per_trigger=max(4, -(-files // BATCHES)))


@query("stream_listing", f"select bucket, entry_type, key, size, version_id from r where {EVERY_STEP}", ("r",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "emitted")
    rows = stream_listing(_stream(spark, sf_dir), ALL).select("bucket", "entry_type", "key", "size", "version_id")
    append_to(rows, path, scratch(spark, "state")).awaitTermination()
    return spark.read.parquet(path)


@query(
    "stream_prefixes",
    f"""select distinct bucket, 'PREFIX' as entry_type, {boundary('data/', 2)} as key from r
where starts_with(key, 'data/') and {slashes(rel('data/'))} >= 2""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "emitted")
    append_to(stream_prefixes(_stream(spark, sf_dir), "data/", 2), path, scratch(spark, "state")).awaitTermination()
    return spark.read.parquet(path)


def _two_halves(spark: SparkSession, sf_dir: str, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """A stream over half of the versions, then, from its checkpoint, over the files that came meanwhile."""
    path = scratch(spark, "arriving")
    rows = fixtures.versions(spark, sf_dir)
    late = F.pmod(F.xxhash64("version_id"), F.lit(2)) == 1
    for half in (rows.where(~late), rows.where(late)):
        half.write.mode("append").parquet(path)
        run(read_stream(spark, path, LISTING_SCHEMA, files_per_trigger=4)).awaitTermination()


@query(
    "stream_listing_staged",
    "select bucket, entry_type, key, size from (" + level_rows("objects", "", 2, where="bucket = 'bkt-1'")
    + ") l where entry_type = 'PREFIX' or size >= 40960",
    ("objects",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, state = scratch(spark, "emitted"), scratch(spark, "state")

    def run(rows: DataFrame) -> StreamingQuery:
        listed = stream_listing(rows, FilterConfig(larger_size="40KiB"), whole=False, bucket="bkt-1", max_depth=2)
        return append_to(listed.select("bucket", "entry_type", "key", "size"), path, state)

    _two_halves(spark, sf_dir, run)
    return spark.read.parquet(path)


@query(
    "emit_prefixes",
    f"""select distinct bucket, 'PREFIX' as entry_type, {boundary('data/', 2)} as key from r
where starts_with(key, 'data/') and {slashes(rel('data/'))} >= 2""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, state = scratch(spark, "prefixes"), scratch(spark, "state")
    _two_halves(spark, sf_dir, lambda rows: emit_prefixes(rows, path, state, "data/", 2))
    return read_prefixes(spark, path)


@query("stream_summary", f"select bucket, {TOTALS} from r group by bucket", ("r",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "totals")
    refresh_totals(stream_summary(_stream(spark, sf_dir)), path, scratch(spark, "state")).awaitTermination()
    return read_totals(spark, path)


@query(
    "estimate_requests",
    "select bucket, cast(ceil(count(*) / 1000.0) as bigint) as requests from r group by bucket",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate_requests(fixtures.versions(spark, sf_dir))


@query(
    "estimate_requests_level",
    "select bucket, cast(ceil(count(*) / 10.0) as bigint) as requests from (" + level_rows("r", "", 1)
    + ") l group by bucket",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.versions(spark, sf_dir)
    return estimate_requests(list_level(rows), max_keys=10)


@query(
    "estimate_requests_parallel",
    f"""select bucket, cast(sum(greatest(1, ceil(entries / 100.0))) as bigint) as requests from (
  select bucket, lvl, prefix, sum(objects) + count(distinct child) as entries from (
    select bucket, lvl, case lvl when 0 then '' when 1 then {boundary('', 1)} when 2 then {boundary('', 2)}
      else {boundary('', 3)} end as prefix, case when lvl = least({slashes('key')}, 3) then 1 else 0 end as objects,
      case when lvl < least({slashes('key')}, 3) then case lvl when 0 then {boundary('', 1)} when 1 then {boundary('', 2)}
        else {boundary('', 3)} end end as child
    from r join (select 0 as lvl union all select 1 union all select 2 union all select 3) n
      on lvl <= least({slashes('key')}, 3)) x
  group by bucket, lvl, prefix) p group by bucket""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.versions(spark, sf_dir)
    return estimate_requests(rows, max_keys=100, parallel_depth=2)


@query(
    "audit_pages",
    """select bucket, mode, page_no, problem from (select bucket, mode, page_no, case
  when mode = 'buckets' and next_token <> '' and next_token = before_token then 'repeated_token'
  when mode = 'objects' and is_truncated and next_token is null then 'missing_token'
  when mode = 'objects' and is_truncated and next_token = before_token then 'repeated_token'
  when mode = 'versions' and is_truncated and next_key_marker is null then 'missing_token'
  when mode = 'versions' and is_truncated and next_key_marker = before_key
    and next_version_id_marker is not distinct from before_id then 'repeated_token' end as problem
  from (select *, lag(next_token) over w as before_token, lag(next_key_marker) over w as before_key,
    lag(next_version_id_marker) over w as before_id
    from page_log window w as (partition by bucket, mode order by page_no)) l) a where problem is not null""",
    ("page_log",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_pages(fixtures.page_log(spark, sf_dir)).drop("prefix")


ACTUAL = """select bucket, key, version_id from r where size % 10 <> 3
union all select bucket, key, version_id from r where size % 10 = 1
union all select bucket, concat(key, '.new'), version_id from r where size % 10 = 2"""


RECONCILED = f"""select bucket, key, version_id, expected_count, actual_count, case when actual_count = 0 then 'missing'
  when expected_count = 0 then 'unexpected' when actual_count > expected_count then 'duplicate' else 'missing' end as status
from (select bucket, key, version_id, coalesce(e, 0) as expected_count, coalesce(a, 0) as actual_count from
  (select bucket, key, version_id, count(*) as e from r group by 1, 2, 3) x full outer join
  (select bucket, key, version_id, count(*) as a from ({ACTUAL}) y group by 1, 2, 3) z using (bucket, key, version_id)) c
where expected_count <> actual_count"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    expected = fixtures.versions(spark, sf_dir).select("bucket", "key", "version_id", "size")
    last = F.col("size") % 10
    added = expected.filter(last == 2).withColumn("key", F.concat("key", F.lit(".new")))
    return expected, expected.filter(last != 3).union(expected.filter(last == 1)).union(added)


@query("reconcile", RECONCILED, ("r",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(*_sides(spark, sf_dir))


@query("reconcile_by_prefix", RECONCILED, ("r",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_by_prefix(*_sides(spark, sf_dir), depth=4)


@query(
    "differing_prefixes",
    f"""select distinct bucket, lvl as level, case lvl when 0 then '' when 1 then {boundary('', 1)} else {boundary('', 2)} end as prefix
from ({RECONCILED}) d join (select 0 as lvl union all select 1 union all select 2) n on lvl <= {slashes('key')}""",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differing_prefixes(*_sides(spark, sf_dir))
