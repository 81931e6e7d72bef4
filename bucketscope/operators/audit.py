"""Request-cost estimates, page-chain audits and reconciliation of listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.operators.hierarchy import DISCOVERY_DEPTH, ancestors, directory_of, prefix_counts
from bucketscope.plans.skew import previous_values
from bucketscope.session import small_tasks, stored
from bucketscope.sources.targets import BROADCAST_BYTES, ROW_BYTES, under

MAX_KEYS = 1000  # fixed value: largest page of a listing request


def _pages(rows: Column, max_keys: int) -> Column:
    return F.ceil(rows / F.lit(max_keys)).cast("bigint")


def estimate_requests(
    df: DataFrame,
    max_keys: int = MAX_KEYS,
    parallel_depth: int | None = None,
    prefix: str | None = None,
    buckets: DataFrame | None = None,
) -> DataFrame:
    """Listing requests per bucket: ``bucket, requests``.

    Without ``parallel_depth`` the listing is one chain of pages. With it, every directory down to that depth is
    listed by itself and each one below is a chain of its own. ``buckets`` (a ``bucket`` column) adds buckets
    without rows, which still take one request.
    """
    if max_keys < 1:
        raise ValueError("max_keys must be positive")
    if parallel_depth is None:
        per_bucket = df.groupBy("bucket").agg(_pages(F.count("*"), max_keys).alias("requests"))
    else:
        pages = level_requests(df, max_keys, parallel_depth, prefix)
        per_bucket = pages.groupBy("bucket").agg(F.sum("requests").alias("requests"))
    if buckets is None:
        return per_bucket
    idle = buckets.select("bucket", F.lit(1).cast("bigint").alias("requests"))
    return per_bucket.unionByName(idle).groupBy("bucket").agg(F.max("requests").alias("requests"))


def level_requests(
    df: DataFrame, max_keys: int = MAX_KEYS, parallel_depth: int = DISCOVERY_DEPTH, prefix: str | None = None
) -> DataFrame:
    """Requests per directory of a parallel listing: ``bucket, prefix, level, entries, requests``."""
    if parallel_depth < 0:
        raise ValueError("parallel_depth must not be negative")
    prefix = prefix or ""
    counts = prefix_counts(df, prefix, parallel_depth + 1)
    # every directory on the way to a row, with the rows that lie in it
    here = F.when(F.col("at.level") == F.col("level"), F.col("objects") + F.col("markers")).otherwise(0)
    paths = counts.select(
        "bucket", "level", "objects", "markers",
        F.explode(ancestors(F.col("prefix"), prefix, F.col("level"), 0)).alias("at"),
    ).groupBy("bucket", "at.level", "at.prefix").agg(F.sum(here).alias("entries"))
    # a directory is an entry of the one above it
    above = F.when(F.col("level") == 1, F.lit(prefix)).otherwise(F.regexp_replace("prefix", "[^/]*/$", ""))
    itself = F.struct("level", "prefix", "entries")
    as_child = F.struct(
        (F.col("level") - 1).alias("level"), above.alias("prefix"), F.lit(1).cast("bigint").alias("entries")
    )
    entries = F.when(F.col("level") > 0, F.array(itself, as_child)).otherwise(F.array(itself))
    total = paths.select("bucket", F.inline(entries)).groupBy("bucket", "prefix", "level").agg(
        F.sum("entries").alias("entries")
    )
    return total.withColumn("requests", F.greatest(_pages(F.col("entries"), max_keys), F.lit(1).cast("bigint")))


def audit_pages(pages: DataFrame) -> DataFrame:
    """Pages after which a listing cannot go on: ``missing_token`` or ``repeated_token``.

    Object listings carry a token, version listings a key and version marker pair, bucket listings a token whose
    absence (or emptiness) just ends the chain. A repeated one equals that of the page before.
    """
    listing = ["bucket", "prefix", "mode"]
    tokens = ["next_token", "next_key_marker", "next_version_id_marker"]
    before = previous_values(pages, listing, "page_no", tokens)
    mode, truncated = F.col("mode"), F.col("is_truncated")
    same_token = F.col("next_token") == F.col("previous_next_token")
    same_pair = (F.col("next_key_marker") == F.col("previous_next_key_marker")) & F.equal_null(
        "next_version_id_marker", "previous_next_version_id_marker"
    )
    problem = (
        F.when((mode == "buckets") & (F.col("next_token") != "") & same_token, "repeated_token")
        .when((mode == "objects") & truncated & F.col("next_token").isNull(), "missing_token")
        .when((mode == "objects") & truncated & same_token, "repeated_token")
        .when((mode == "versions") & truncated & F.col("next_key_marker").isNull(), "missing_token")
        .when((mode == "versions") & truncated & same_pair, "repeated_token")
    )
    return before.select(*listing, "page_no", problem.alias("problem")).filter(F.col("problem").isNotNull())


def reconcile(
    expected: DataFrame, actual: DataFrame, on: Sequence[str] = ("bucket", "key", "version_id"), rows: int | None = None
) -> DataFrame:
    """Keys that differ: ``missing``, ``unexpected`` or ``duplicate``, with their counts on both sides.

    Both sides are counted in one aggregation, so repeated keys never meet in a join. It runs at once, in as many tasks as
    count a bounded number of keys each; the result is read from what it stored. ``rows`` is the number of rows of both
    sides, where it is known.
    """
    rows = expected.count() + actual.count() if rows is None else rows
    with small_tasks(expected.sparkSession, rows):
        return stored(_counted(expected, actual, on), "reconciled")


def _counted(expected: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    both = expected.select(*on, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(
        actual.select(*on, F.lit(0).alias("e"), F.lit(1).alias("a"))
    )
    counts = both.groupBy(*on).agg(F.sum("e").alias("expected_count"), F.sum("a").alias("actual_count"))
    status = (
        F.when(F.col("actual_count") == 0, "missing")
        .when(F.col("expected_count") == 0, "unexpected")
        .when(F.col("actual_count") > F.col("expected_count"), "duplicate")
        .when(F.col("actual_count") < F.col("expected_count"), "missing")
    )
    return counts.withColumn("status", status).filter(F.col("status").isNotNull())


def _digests(df: DataFrame, on: Sequence[str], prefix: str, depth: int, sign: int) -> DataFrame:
    """Per directory, cut at ``depth`` levels: how many rows, and sums of two hashes of the rows. The sums do not depend on
    the order of the rows, and rows that repeat count each time. Tasks merge their rows before the shuffle."""
    at, level = directory_of(F.col("key"), prefix, depth)
    values = [part for c in on for part in (F.col(c), F.col(c).isNull())]
    hashes = [F.xxhash64(F.lit(seed), *values).cast("decimal(20,0)") for seed in (1, 2)]
    sums = [F.sum(h * sign).alias(f"digest_{n}") for n, h in enumerate(hashes)]
    return under(df, prefix).groupBy("bucket", at.alias("prefix"), level.alias("level")).agg(F.count(F.lit(sign)).alias("rows"), *sums)


def _differing(expected: DataFrame, actual: DataFrame, on: Sequence[str], prefix: str, depth: int) -> DataFrame:
    sides = [_digests(df, on, prefix, depth, sign).withColumn("side", F.lit(sign)) for df, sign in ((expected, 1), (actual, -1))]
    both = sides[0].unionByName(sides[1]).groupBy("bucket", "prefix", "level").agg(
        F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("rows"))), F.lit(0)).alias("expected_count"),
        F.coalesce(F.sum(F.when(F.col("side") == -1, F.col("rows"))), F.lit(0)).alias("actual_count"),
        F.sum("digest_0").alias("digest_0"),
        F.sum("digest_1").alias("digest_1"),
    )
    same = (F.col("expected_count") == F.col("actual_count")) & (F.col("digest_0") == 0) & (F.col("digest_1") == 0)
    return both.where(~same).drop("digest_0", "digest_1")


def differing_prefixes(
    expected: DataFrame,
    actual: DataFrame,
    on: Sequence[str] = ("bucket", "key", "version_id"),
    prefix: str | None = None,
    depth: int = DISCOVERY_DEPTH,
) -> DataFrame:
    """Directories down to ``depth`` levels below which two listings differ: ``bucket, level, prefix``.

    Directories are compared by digests of their rows, so no key is shuffled. Two 64-bit sums and a count stand for the rows.
    """
    found = _differing(expected, actual, on, prefix or "", depth)
    above = found.select("bucket", F.explode(ancestors(F.col("prefix"), prefix or "", F.col("level"), 0)).alias("at"))
    return above.select("bucket", "at.level", "at.prefix").distinct()


def reconcile_by_prefix(
    expected: DataFrame,
    actual: DataFrame,
    on: Sequence[str] = ("bucket", "key", "version_id"),
    prefix: str | None = None,
    depth: int = DISCOVERY_DEPTH,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """As :func:`reconcile` of what lies under ``prefix``, but only keys of directories whose digests differ are compared.

    Equal inventories shuffle a row per directory and no key. The differing directories are broadcast where they take up to
    ``broadcast_bytes``.
    """
    prefix = prefix or ""
    counted = F.col("expected_count") + F.col("actual_count")
    differing = _differing(expected, actual, on, prefix, depth).select("bucket", F.col("prefix").alias("at"), counted.alias("rows"))
    found = stored(differing, "differing")
    size = F.octet_length("bucket") + F.octet_length("at") + F.lit(ROW_BYTES)
    directories, taken, rows = found.agg(F.count(F.lit(1)), F.sum(size), F.sum("rows")).first()
    found = found.drop("rows")
    if not directories:
        return _counted(expected.limit(0), actual.limit(0), on)

    def within(df: DataFrame) -> DataFrame:
        placed = under(df, prefix).withColumn("at", directory_of(F.col("key"), prefix, depth)[0]).alias("rows")
        chosen = (F.broadcast(found) if taken <= broadcast_bytes else found.hint("merge")).alias("chosen")
        same = F.col("rows.bucket").eqNullSafe(F.col("chosen.bucket")) & F.col("rows.at").eqNullSafe(F.col("chosen.at"))
        return placed.join(chosen, same, "left_semi").select(*on)

    return reconcile(within(expected), within(actual), on, rows)
