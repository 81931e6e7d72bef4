"""Inventory tables derived from the test tables, for Spark and as SQL text for the check engine.

Row-level expressions are shared by both engines. What differs is how the latest version of a key is found: SQL uses a
window, Spark the sort in which the table is stored, because a key with very many versions would put a window's rows in
one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.functions.keys import prefix_at_depth
from bucketscope.operators.hierarchy import latest_marked, prefix_rows, write_sorted
from bucketscope.operators.versions import current_view
from bucketscope.schema import DELETE_MARKER, LISTING_SCHEMA, OBJECT, PAGE_LOG_SCHEMA, PREFIX
from bucketscope.session import scratch, small_tasks
from bucketscope.sources.manifest import write_manifest
from bucketscope.sources.targets import under

BUCKET = "concat('bkt-', cast(l_suppkey % 5 as string), case when l_suppkey % 5 = 4 then '--x-s3' else '' end)"
KEY = """case l_partkey % 50
  when 0 then concat('manifest-', cast(l_orderkey % 20 as string), '.json')
  when 1 then concat('data/', lower(l_returnflag), '/', cast(year(l_shipdate) as string), '/')
  when 2 then concat('logs', chr(9), 'raw/', cast(l_orderkey % 20 as string), chr(10), '.log')
  else concat('data/', lower(l_returnflag), '/', cast(year(l_shipdate) as string), '/',
              cast(month(l_shipdate) as string), '/part-', cast(l_orderkey % 20 as string), '.parquet') end"""
VERSION_ID = """concat('v', cast(l_orderkey as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-',
  cast(l_linenumber as string), '-', cast(cast(round(l_quantity) as int) as string), '-',
  cast(cast(round(l_discount*100) as int) as string), '-', cast(cast(round(l_tax*100) as int) as string))"""
MARKER = "l_partkey % 17 = 0"

#: column -> expression over lineitem, valid in both engines
VERSION_COLUMNS = {
    "bucket": BUCKET,
    "entry_type": f"case when {MARKER} then '{DELETE_MARKER}' else '{OBJECT}' end",
    "key": KEY,
    "size": f"""case when {MARKER} or l_partkey % 50 = 1 then cast(0 as bigint)
  else cast(round(l_extendedprice) as bigint) end""",
    "last_modified": "cast(l_shipdate as timestamp)",
    "storage_class": f"""case when {MARKER} then cast(null as string) else case l_partkey % 4
  when 0 then cast(null as string) when 1 then 'STANDARD_IA' when 2 then 'GLACIER' else 'STANDARD' end end""",
    "checksum_csv": f"""case when {MARKER} then '' else case l_linenumber % 3
  when 0 then '' when 1 then 'CRC32' else 'CRC32C,SHA256' end end""",
    "checksum_type": f"""case when {MARKER} then cast(null as string) else case l_partkey % 3
  when 0 then cast(null as string) when 1 then 'FULL_OBJECT' else 'COMPOSITE' end end""",
    "owner_display_name": """case when l_suppkey % 6 = 0 then cast(null as string) else
  concat('owner', case when l_suppkey % 13 = 0 then chr(27) else '-' end, cast(l_suppkey % 6 as string)) end""",
    "owner_id": "cast(l_suppkey as string)",
    "is_restore_in_progress": f"""case when {MARKER} then cast(null as boolean) else case l_partkey % 5
  when 0 then true when 1 then false else cast(null as boolean) end end""",
    "restore_expiry_date": f"""case when not ({MARKER}) and l_partkey % 5 = 1
  then concat(cast(year(l_shipdate) + 1 as string), '-01-01T00:00:00Z') end""",
    "version_id": VERSION_ID,
}
E_TAG = f"case when entry_type = '{DELETE_MARKER}' then '' else concat('\"', md5(concat(key, version_id)), '\"') end"

BUCKET_COLUMNS = {
    "name": "concat('bucket-', cast(s_suppkey as string), case when s_suppkey % 5 = 4 then '--x-s3' else '' end)",
    "creation_date": """case when s_suppkey % 11 = 0 then cast(null as timestamp)
  else cast(date '2020-01-01' + cast(s_suppkey % 700 as int) as timestamp) end""",
    "region": "case when s_suppkey % 7 = 0 then cast(null as string) else lower(n_name) end",
    "bucket_arn": "concat('arn:aws:s3:::bucket-', cast(s_suppkey as string))",
    "owner_display_name": "s_name",
    "owner_id": "cast(s_nationkey as string)",
}

TARGET_COLUMNS = {
    "bucket": """concat('bkt-', cast(o_custkey % 5 as string), case when o_custkey % 5 = 4 then '--x-s3' else '' end)""",
    "prefix": """case when o_custkey % 97 = 0 then cast(null as string) else concat('data/',
  case o_orderkey % 3 when 0 then 'a' when 1 then 'n' else 'r' end, '/', cast(year(o_orderdate) as string),
  case o_orderkey % 4 when 0 then '' when 1 then '/' else concat('/', cast(month(o_orderdate) as string), '/part-1') end)
  end""",
}

#: page log columns: group keys, then aggregates over the rows of a page
PAGE_KEYS = {
    "bucket": BUCKET,
    "mode": "case l_suppkey % 5 when 3 then 'versions' when 4 then 'buckets' else 'objects' end",
    "page_no": "l_orderkey * 8 + l_linenumber",
}
PAGE_VALUES = {
    "is_truncated": "min(l_partkey) % 7 <> 0",
    "token": """case when min(l_partkey) % 31 = 0 then cast(null as string) when min(l_partkey) % 37 = 0 then ''
  else concat('tok-', cast(min(l_partkey) % 3 as string)) end""",
    "id_marker": "case when min(l_partkey) % 4 = 0 then cast(null as string) else cast(min(l_partkey) % 2 as string) end",
}

RAW_COLUMNS = {
    "bucket": BUCKET,
    "key": f"case when l_orderkey % 23 = 0 then cast(null as string) else {KEY} end",
    "size": "case when l_partkey % 19 = 0 then cast(null as bigint) when l_partkey % 19 = 1 then cast(-5 as bigint) "
    "else cast(round(l_extendedprice) as bigint) end",
    "last_modified": "case when l_orderkey % 29 = 0 then cast(null as timestamp) else cast(l_shipdate as timestamp) end",
    "e_tag": "case when l_linenumber = 2 then cast(null as string) else concat('\"', cast(l_partkey as string), '\"') end",
    "owner_id": "cast(l_suppkey as string)",
    "version_id": f"case when l_linenumber = 3 then cast(null as string) else {VERSION_ID} end",
    "is_latest": "case when l_linenumber = 4 then cast(null as boolean) else l_linenumber % 2 = 0 end",
    "is_delete_marker": MARKER,
}


_PATHS: dict[tuple[str, str, str], str] = {}


def _expressions(columns: dict[str, str]) -> list[str]:
    return [f"{expression} as {name}" for name, expression in columns.items()]


def _select(columns: dict[str, str], source: str) -> str:
    return f"select {', '.join(_expressions(columns))} from {source}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _finish(df: DataFrame) -> DataFrame:
    """The listing layout from the shared columns."""
    checksums = F.when(F.col("checksum_csv") == "", F.array().cast("array<string>")).otherwise(
        F.split("checksum_csv", ",")
    )
    known = {"e_tag": F.expr(E_TAG), "checksum_algorithm": checksums}
    return df.select([known.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in LISTING_SCHEMA.fields])


#: columns that order versions and tell which is the latest of a key
ORDERED = ("bucket", "key", "last_modified", "version_id")


def derive_versions(lineitem: DataFrame) -> DataFrame:
    """All versions and delete markers in key order, the latest of each key marked. All is derived behind the exchange, from
    what it takes of a line item."""
    marked = latest_marked(lineitem, **{name: F.expr(VERSION_COLUMNS[name]) for name in ORDERED})
    return _finish(marked.selectExpr("is_latest", *_expressions(VERSION_COLUMNS)))


def _written(spark: SparkSession, sf_dir: str, name: str, write: Callable[[DataFrame, str], None]) -> str:
    """A table derived from lineitem, written once per application to the shared scratch folder."""
    where = (spark.sparkContext.applicationId, sf_dir, name)
    if where not in _PATHS:
        path = scratch(spark, name)
        rows = table(spark, sf_dir, "lineitem")
        with small_tasks(spark, rows.count()):
            write(rows, path)
        _PATHS[where] = path
    return _PATHS[where]


def inventory_path(spark: SparkSession, sf_dir: str) -> str:
    """The version table as Parquet files in key order.

    Listings are made to run over stored inventories, so the queries do the same: filters and column choice reach the
    scan, and the files give it its parallelism.
    """
    return _written(spark, sf_dir, "inventory", lambda rows, path: write_sorted(derive_versions(rows), path))


def indexed_inventory_path(spark: SparkSession, sf_dir: str) -> str:
    """The same files, with their index."""
    path = inventory_path(spark, sf_dir)
    where = (spark.sparkContext.applicationId, sf_dir, "index")
    if where not in _PATHS:
        write_manifest(spark, path)
        _PATHS[where] = path
    return path


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(LISTING_SCHEMA).parquet(inventory_path(spark, sf_dir))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current objects of the version table."""
    return current_view(versions(spark, sf_dir))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version and delete marker, and as PREFIX rows the directories three levels below ``data/``."""
    rows = versions(spark, sf_dir)
    return rows.unionByName(prefix_rows(under(rows, "data/"), prefix_at_depth(F.col("key"), "data/", 3), like=rows))


def tree_path(spark: SparkSession, sf_dir: str) -> str:
    """A directory tree of the current objects, written by tasks, once per application: ``bucket/key``, with the version as
    content. Keys that end in a slash have no file."""
    where = (spark.sparkContext.applicationId, sf_dir, "tree")
    if where not in _PATHS:
        path = scratch(spark, "objects")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = fs.FileSystem.from_uri(path)
            made: set[str] = set()
            for batch in batches:
                for key, content in zip(*[column.to_pylist() for column in batch.columns]):
                    file = f"{root}/{key}"
                    folder = file.rsplit("/", 1)[0]
                    if folder not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    with system.open_output_stream(file, compression=None) as out:
                        out.write(content.encode())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

        rows = objects_with_versions(spark, sf_dir).where(~F.col("key").endswith("/"))
        named = rows.select(F.concat_ws("/", "bucket", "key").alias("key"), "version_id")
        named.mapInArrow(write, "n long").agg(F.sum("n")).collect()
        _PATHS[where] = path
    return _PATHS[where]


def objects_with_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).where((F.col("entry_type") == OBJECT) & F.col("is_latest"))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(*_expressions(BUCKET_COLUMNS))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_expressions(TARGET_COLUMNS)).distinct()


def uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("url", "concat('s3://', regexp_replace(url, '^https?://', '')) as target")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_expressions(RAW_COLUMNS))


def derive_page_log(lineitem: DataFrame) -> DataFrame:
    keyed = lineitem.selectExpr(*_expressions(PAGE_KEYS), "l_partkey")
    pages = keyed.groupBy(*PAGE_KEYS).agg(*[F.expr(e).alias(n) for n, e in PAGE_VALUES.items()])
    versioned = F.col("mode") == "versions"
    known = {
        "prefix": F.lit(None),
        "next_token": F.when(~versioned, F.col("token")),
        "next_key_marker": F.when(versioned, F.col("token")),
        "next_version_id_marker": F.when(versioned, F.col("id_marker")),
    }
    return pages.select([known.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in PAGE_LOG_SCHEMA.fields])


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir, "page-log", lambda rows, path: derive_page_log(rows).write.parquet(path))
    return spark.read.schema(PAGE_LOG_SCHEMA).parquet(path)


_MARKED = f"""select r.*, {E_TAG} as e_tag, row_number() over (
  partition by bucket, key order by last_modified desc, version_id desc) = 1 as is_latest from r"""

_NO_VALUES = ", ".join(
    f"cast(null as {'boolean' if c.startswith('is_') else 'varchar'})"
    for c in VERSION_COLUMNS
    if c not in ("bucket", "entry_type", "key", "size", "last_modified")
)
_ENTRIES = f"""select {', '.join(VERSION_COLUMNS)}, e_tag, is_latest from versions
union all select distinct bucket, '{PREFIX}', regexp_extract(key, '^(data/([^/]*/){{3}})', 1), cast(0 as bigint),
  cast(null as timestamp), {_NO_VALUES}, cast(null as varchar), cast(null as boolean)
from versions where regexp_matches(key, '^data/([^/]*/){{3}}')"""

#: common table expressions by view name; a view may use those before it
VIEWS = {
    "r": _select(VERSION_COLUMNS, "lineitem"),
    "versions": _MARKED,
    "objects": f"select * exclude (version_id, is_latest) from versions where is_latest and entry_type = '{OBJECT}'",
    "entries": _ENTRIES,
    "files": f"select concat_ws('/', bucket, key) as key, cast(length(version_id) as bigint) as size from versions "
    f"where is_latest and entry_type = '{OBJECT}' and key not like '%/'",
    "buckets": _select(BUCKET_COLUMNS, "supplier join nation on s_nationkey = n_nationkey"),
    "targets": "select distinct * from (" + _select(TARGET_COLUMNS, "orders") + ") t",
    "uris": "select url, concat('s3://', regexp_replace(url, '^https?://', '')) as target from pages",
    "raw_rows": _select(RAW_COLUMNS, "lineitem"),
    "page_log": "select bucket, mode, page_no, is_truncated, "
    "case when mode <> 'versions' then token end as next_token, "
    "case when mode = 'versions' then token end as next_key_marker, "
    "case when mode = 'versions' then id_marker end as next_version_id_marker from ("
    + f"select {', '.join(PAGE_KEYS)}, {', '.join(_expressions(PAGE_VALUES))} from ("
    + f"select {', '.join(_expressions(PAGE_KEYS))}, l_partkey from lineitem) k group by {', '.join(PAGE_KEYS)}) p",
}
NEEDS = {"entries": ["r", "versions"], "files": ["r", "versions"], "objects": ["r", "versions"], "versions": ["r"]}


def with_views(query: str, *views: str) -> str:
    """``query`` after the views it reads, as one SQL text."""
    wanted: list[str] = []
    for view in views:
        for name in (*NEEDS.get(view, []), view):
            if name not in wanted:
                wanted.append(name)
    ctes = ",\n".join(f"{name} as ({VIEWS[name]})" for name in wanted)
    return f"with {ctes}\n{query}" if wanted else query
