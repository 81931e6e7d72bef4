"""Filters, each over all versions and delete markers, and together over a listing with directories."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope import fixtures
from bucketscope.catalog.registry import query
from bucketscope.catalog.text import level_rows
from bucketscope.functions.scalars import parse_size
from bucketscope.operators.filters import FilterConfig, apply_filters, hide_delete_markers, rejections
from bucketscope.operators.hierarchy import list_recursive

COLUMNS = ("bucket", "entry_type", "key", "size", "version_id")
PIVOT = dt.datetime(1999, 6, 15)
ALL = FilterConfig(
    include_regex=r"^data/.*(parquet|/)$",
    exclude_regex=r"part-1[0-9]",
    mtime_before=dt.datetime(2001, 1, 1),
    mtime_after=dt.datetime(1996, 3, 1),
    smaller_size="60KiB",
    larger_size="1KB",
    storage_class=("STANDARD", "GLACIER"),
)
#: filter name -> (filter, SQL test over r)
SINGLE = {
    "include_regex": (FilterConfig(include_regex=r"part-1[0-9]\.parquet$"), r"regexp_matches(key, 'part-1[0-9]\.parquet\z')"),
    "include_regex_whitespace": (
        FilterConfig(include_regex=r"^logs\sraw/[0-9]+\s\.log$"),
        r"regexp_matches(key, '^logs\sraw/[0-9]+\s\.log\z')",
    ),
    "exclude_regex": (FilterConfig(exclude_regex=r"\.log$|^manifest"), r"not regexp_matches(key, '\.log\z|^manifest')"),
    "mtime_before": (FilterConfig(mtime_before=PIVOT), "last_modified < timestamp '1999-06-15'"),
    "mtime_after": (FilterConfig(mtime_after=PIVOT), "last_modified >= timestamp '1999-06-15'"),
    "smaller_size": (FilterConfig(smaller_size="32KiB"), "(entry_type = 'DELETE_MARKER' or size < 32768)"),
    "larger_size": (FilterConfig(larger_size="32KB"), "(entry_type = 'DELETE_MARKER' or size >= 32000)"),
    "storage_class": (
        FilterConfig(storage_class=("GLACIER",)),
        "(entry_type = 'DELETE_MARKER' or storage_class = 'GLACIER')",
    ),
    "storage_class_standard": (
        FilterConfig(storage_class=("STANDARD", "STANDARD_IA")),
        "(entry_type = 'DELETE_MARKER' or coalesce(storage_class, 'STANDARD') in ('STANDARD', 'STANDARD_IA'))",
    ),
}
#: tests of ALL, in order
STEPS = {
    "include_regex": r"regexp_matches(key, '^data/.*(parquet|/)\z')",
    "exclude_regex": "not regexp_matches(key, 'part-1[0-9]')",
    "mtime_before": "last_modified < timestamp '2001-01-01'",
    "mtime_after": "last_modified >= timestamp '1996-03-01'",
    "smaller_size": "(entry_type = 'DELETE_MARKER' or size < 61440)",
    "larger_size": "(entry_type = 'DELETE_MARKER' or size >= 1000)",
    "storage_class": "(entry_type = 'DELETE_MARKER' or coalesce(storage_class, 'STANDARD') in ('STANDARD', 'GLACIER'))",
}
EVERY_STEP = " and ".join(STEPS.values())


def _all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.versions(spark, sf_dir)


def _register(name: str, config: FilterConfig, test: str) -> None:
    @query(f"filter_{name}", f"select {', '.join(COLUMNS)} from r where {test}", ("r",))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply_filters(_all_rows(spark, sf_dir), config).select(*COLUMNS)


for _name, (_config, _test) in SINGLE.items():
    _register(_name, _config, _test)


@query("filter_all", f"select {', '.join(COLUMNS)} from r where {EVERY_STEP}", ("r",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_filters(_all_rows(spark, sf_dir), ALL).select(*COLUMNS)


@query(
    "filter_keeps_prefixes",
    "select bucket, entry_type, key, size from (" + level_rows("r", "data/", 3)
    + ") l where entry_type = 'PREFIX' or key like '%/'",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = list_recursive(_all_rows(spark, sf_dir), "data/", max_depth=3)
    return apply_filters(rows, FilterConfig(include_regex="/$")).select("bucket", "entry_type", "key", "size")


@query("hide_delete_markers", f"select {', '.join(COLUMNS)} from r where entry_type <> 'DELETE_MARKER'", ("r",))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hide_delete_markers(_all_rows(spark, sf_dir)).select(*COLUMNS)


@query(
    "rejections",
    "select filter, count(*) as dropped from (select case "
    + " ".join(f"when not ({test}) then '{name}'" for name, test in STEPS.items())
    + " end as filter from r) d where filter is not null group by filter",
    ("r",),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejections(_all_rows(spark, sf_dir), ALL)


SIZE_TEXT = """concat(cast(p_size as string), case p_partkey % 4 when 1 then '.5' else '' end, case p_partkey % 9
  when 0 then '' when 1 then 'KB' when 2 then 'KiB' when 3 then 'MB' when 4 then 'MiB' when 5 then 'GB' when 6 then 'GiB'
  when 7 then 'TiB' else 'Zib' end)"""


@query(
    "parse_size",
    """select p_partkey, size_text, cast(ceil(cast(regexp_extract(size_text, '^([0-9.]+)', 1) as double) * factor) as bigint)
as size from (select p_partkey, size_text, case p_partkey % 9 when 0 then 1 when 1 then 1000 when 2 then 1024
  when 3 then 1000000 when 4 then 1048576 when 5 then 1000000000 when 6 then 1073741824 when 7 then 1099511627776 end
as factor from (select p_partkey, """ + SIZE_TEXT + " as size_text from part) t) f",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fixtures.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{SIZE_TEXT} as size_text")
    return texts.withColumn("size", parse_size(F.col("size_text")).cast("bigint"))
