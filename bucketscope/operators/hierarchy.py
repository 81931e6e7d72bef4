"""Virtual directories: one-level, depth-limited and recursive listings, and prefix discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.functions.keys import after_prefix, key_depth, prefix_at_depth, slashes
from bucketscope.plans.ranges import instant_text, mark_last
from bucketscope.schema import DELETE_MARKER, OBJECT, PREFIX
from bucketscope.session import setting
from bucketscope.sources.targets import under

DISCOVERY_DEPTH = 2  # fixed value: default number of levels discovered


def prefix_rows(df: DataFrame, boundary: Column, like: DataFrame) -> DataFrame:
    """Distinct ``(bucket, boundary)`` pairs as PREFIX rows with the columns of ``like``.

    Only bucket and key reach the scan, and equal pairs are merged before the shuffle.
    """
    found = df.select("bucket", boundary.alias("key")).filter(F.col("key").isNotNull()).distinct()
    known = {"bucket": F.col("bucket"), "key": F.col("key"), "entry_type": F.lit(PREFIX), "size": F.lit(0)}
    return found.select([
        known.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name) for field in like.schema.fields
    ])


def list_recursive(
    df: DataFrame, prefix: str | None = None, max_depth: int | None = None, marker: str = "rollup"
) -> DataFrame:
    """Every key under ``prefix``; with ``max_depth``, keys within that many levels plus one PREFIX per directory below.

    ``marker`` says what becomes of a directory marker at the limit, such as ``a/`` at depth 1: ``rollup`` folds it
    into PREFIX ``a/``, ``object`` keeps it as an object beside the PREFIX.
    """
    prefix = prefix or ""
    rows = under(df, prefix)
    if max_depth is None:
        return rows
    if max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    key = F.col("key")
    if marker == "rollup":
        deep = slashes(after_prefix(key, prefix)) >= max_depth
    elif marker == "object":
        deep = F.coalesce(key_depth(key, prefix), F.lit(0)) > max_depth
    else:
        raise ValueError("marker must be 'rollup' or 'object'")
    folded = prefix_rows(rows.filter(deep), prefix_at_depth(key, prefix, max_depth), like=df)
    return rows.filter(~deep).unionByName(folded)


def list_level(df: DataFrame, prefix: str | None = None) -> DataFrame:
    """One level: keys without a further slash, and one PREFIX per directory."""
    return list_recursive(df, prefix, max_depth=1, marker="rollup")


def objects_only(df: DataFrame) -> DataFrame:
    """Without PREFIX rows; delete markers stay."""
    return df.filter(F.col("entry_type") != PREFIX)


def _head(text: Column, n: Column) -> Column:
    """Text before the ``n``-th slash."""
    return F.call_function("substring_index", text, F.lit("/"), n.cast("int"))


def directory_of(key: Column, prefix: str, depth: int) -> tuple[Column, Column]:
    """The directory that a key under ``prefix`` lies in, cut at ``depth`` levels, and its level."""
    rel = after_prefix(key, prefix)
    level = F.least(slashes(rel), F.lit(depth))
    at = F.when(level == 0, F.lit(prefix)).otherwise(F.concat(F.lit(prefix), _head(rel, level), F.lit("/")))
    return at, level.cast("int")


def prefix_counts(df: DataFrame, prefix: str, depth: int) -> DataFrame:
    """Rows per directory each key lies in, cut at ``depth`` levels: ``bucket, prefix, level, objects, size, markers``.

    This is the one pass over the keys. What needs counts for upper levels adds these rows up, so a hot directory
    costs one row per task in the shuffle.
    """
    at, level = directory_of(F.col("key"), prefix, depth)
    is_object = F.col("entry_type") == OBJECT
    return (
        under(df, prefix)
        .filter(F.col("entry_type") != PREFIX)
        .groupBy("bucket", at.alias("prefix"), level.alias("level"))
        .agg(
            F.count_if(is_object).alias("objects"),
            F.sum(F.when(is_object, F.col("size")).otherwise(0)).alias("size"),
            F.count_if(F.col("entry_type") == DELETE_MARKER).alias("markers"),
        )
    )


def ancestors(path: Column, prefix: str, level: Column, first: int) -> Column:
    """``array<struct<level, prefix>>`` of a directory path and the directories above it, from level ``first`` on."""
    rel = after_prefix(path, prefix)

    def up(n: Column) -> Column:
        at = F.when(n == 0, F.lit(prefix)).otherwise(
            F.concat(F.lit(prefix), _head(rel, n), F.lit("/"))
        )
        return F.struct(n.cast("int").alias("level"), at.alias("prefix"))

    return F.when(level >= first, F.transform(F.sequence(F.lit(first), level), up))


def discover_prefixes(df: DataFrame, prefix: str | None = None, depth: int = DISCOVERY_DEPTH) -> DataFrame:
    """All directories down to ``depth`` levels, with the number and bytes of objects anywhere under each."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    prefix = prefix or ""
    counts = prefix_counts(df, prefix, depth)
    above = counts.select(
        "bucket", F.explode(ancestors(F.col("prefix"), prefix, F.col("level"), 1)).alias("at"), "objects", "size"
    )
    return above.groupBy("bucket", "at.level", "at.prefix").agg(
        F.sum("objects").alias("object_count"), F.sum("size").alias("total_size")
    )


def repartition_by_prefix(df: DataFrame, n: int | None = None, rows: int | None = None) -> DataFrame:
    """Partitions of neighbouring keys: ``n`` of them, or as many as adaptive execution finds fit the size. With ``rows``, at
    least ``n``, and as many as hold about that many rows each.

    Versions take part in the order, so one key with very many of them is split too.
    """
    by = [c for c in ("bucket", "key", "version_id") if c in df.columns]
    if rows:
        n = max(n or 1, -(-df.count() // rows))
    return df.repartitionByRange(n, *by) if n else df.repartitionByRange(*by)


def write_inventory(
    df: DataFrame, path: str, n: int | None = None, mode: str = "errorifexists", mark_latest: bool = False
) -> None:
    """Store an inventory in key order, so that a scan of one bucket or prefix skips the other files and row groups.

    ``mark_latest`` sets ``is_latest`` for the last version of each key by date, then version, in the same sort.
    """
    if mark_latest:
        rows = latest_marked(df.drop("is_latest"), n).select(df.columns)
    else:
        order = [c for c in ("bucket", "key", "version_id") if c in df.columns]
        rows = repartition_by_prefix(df, n).sortWithinPartitions(*order)
    write_sorted(rows, path, mode)


def latest_marked(df: DataFrame, n: int | None = None, **known: Column) -> DataFrame:
    """Versions in key order, by date and version within a key, with ``is_latest`` for the last of each key. One exchange.
    ``known`` gives expressions for bucket, key, date or version where they are no columns yet."""
    bucket, key, date, version = [known.get(c, F.col(c)) for c in ("bucket", "key", "last_modified", "version_id")]
    return mark_last(df, [bucket, key], [instant_text(date), version], "is_latest", n)


def write_sorted(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store rows that are in key order already.

    Dates are stored as microseconds: the older form that Spark writes by itself has no ranges, so no date test could skip.
    """
    with setting(df.sparkSession, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"):
        df.write.mode(mode).parquet(path)
