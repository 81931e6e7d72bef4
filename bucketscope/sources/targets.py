"""Targets: ``s3://bucket/prefix`` URIs, literal-prefix scans, and many targets against one inventory."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketscope.plans.ranges import range_of, splitters
from bucketscope.session import ship_package, stored

SCHEME = "s3://"
PUSHED_TARGETS = 32
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64  # what a broadcast row takes beside its text
RANGES_PER_PARTITION = 4
HOT_SHARE, HOT_ROWS = 10_000, 1000  # a key with more rows than one in so many, and than so many, is hot
NAME_DIGITS = 6  # digits in front of a bucket's name that say how long it is


def parse_target(uri: Column, on_error: str = "raise") -> Column:
    """``struct(bucket, prefix)`` of a target URI; an empty prefix is NULL.

    A URI without the scheme or without a bucket raises, or gives NULL with ``on_error="null"``.
    """
    bucket = F.regexp_extract(uri, f"^{SCHEME}([^/]*)", 1)
    prefix = F.nullif(F.regexp_extract(uri, f"(?s)^{SCHEME}[^/]*/(.*)$", 1), F.lit(""))
    parsed = F.struct(bucket.alias("bucket"), prefix.alias("prefix"))
    valid = F.when(uri.startswith(SCHEME) & (bucket != ""), parsed)
    if on_error == "null":
        return valid
    problem = F.raise_error(F.concat(F.lit("not a target URI: "), F.coalesce(uri, F.lit("NULL"))))
    return F.coalesce(valid, problem.cast("struct<bucket:string,prefix:string>"))


def format_target(bucket: Column, prefix: Column) -> Column:
    return F.concat(F.lit(SCHEME), bucket, F.coalesce(F.concat(F.lit("/"), prefix), F.lit("")))


def under(df: DataFrame, prefix: str | None) -> DataFrame:
    """Rows whose key starts with ``prefix``, taken literally; the test reaches the Parquet scan."""
    return df.filter(F.col("key").startswith(prefix)) if prefix else df


def under_targets(df: DataFrame, targets: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One listing per target: rows of ``df`` under each ``(bucket, prefix)``, with ``target_prefix`` added.

    Targets that take up to ``broadcast_bytes`` are broadcast and the inventory is not shuffled: a key meets a prefix
    exactly when its head of the prefix's length equals it, so the join is on equality, with a probe per prefix length that
    occurs. More are matched as key intervals, see :func:`matches`, by an exchange of the distinct keys, whatever
    the number of lengths. The rows then find their key's matches; they are shuffled, once, only where these take more than
    ``broadcast_bytes`` too, and then without those of hot keys. Up to ``PUSHED_TARGETS`` also narrow the scan, as plain prefix tests.

    Rows with a null bucket or key are under no target, and neither is a target without a bucket.
    """
    wanted = targets.where("bucket is not null").select("bucket", F.coalesce("prefix", F.lit("")).alias("target_prefix")).distinct()
    taken = F.octet_length("bucket") + F.octet_length("target_prefix") + F.lit(ROW_BYTES)
    sizes = wanted.groupBy(F.length("bucket").alias("named"), F.length("target_prefix").alias("n")).agg(
        F.count("*").alias("targets"), F.sum(taken).alias("bytes")
    ).collect()
    if not sizes:
        return df.withColumn("target_prefix", F.lit(None).cast("string")).filter(F.lit(False))
    if sum(row["targets"] for row in sizes) <= PUSHED_TARGETS:
        tests = [(F.col("bucket") == b) & F.col("key").startswith(p) for b, p in wanted.collect()]
        df = df.filter(reduce(or_, tests))
    if sum(row["bytes"] for row in sizes) <= broadcast_bytes:
        lengths = F.lit(sorted({row["n"] for row in sizes})).cast("array<int>")
        fitting = F.filter(lengths, lambda n: n <= F.length("key"))
        offered = df.withColumn("_length", F.explode(fitting)).withColumn(
            "target_prefix", F.substring("key", F.lit(1), F.col("_length"))
        )
        return offered.join(F.broadcast(wanted), ["bucket", "target_prefix"]).select(*df.columns, "target_prefix")
    lengths = sorted({NAME_DIGITS + row["named"] + row["n"] for row in sizes})
    found = stored(matches(df, wanted, lengths), "matches")
    size = F.octet_length("bucket") + F.octet_length("key") + 4 * F.size("_lengths") + F.lit(ROW_BYTES)
    taken, rows = found.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    on = ["bucket", "key"]
    if taken <= broadcast_bytes:
        joined = df.join(F.broadcast(found), on)
    else:
        # each has at least one in HOT_SHARE of the rows, so there are at most HOT_SHARE of them; theirs are not shuffled
        hot = F.col("_rows") >= max(HOT_ROWS, rows // HOT_SHARE + 1)
        joined = df.join(found.where(~hot).hint("merge"), on)
        if not found.where(hot).isEmpty():
            rest = df.join(F.broadcast(found.where(hot).select(*on)), on, "left_anti")
            joined = rest.join(found.where(~hot).hint("merge"), on).unionByName(df.join(F.broadcast(found.where(hot)), on))
    each = joined.withColumn("_length", F.explode("_lengths"))
    return each.select(*df.columns, F.substring("key", F.lit(1), F.col("_length")).alias("target_prefix"))


def matches(df: DataFrame, wanted: DataFrame, lengths: list[int]) -> DataFrame:
    """``bucket, key, _lengths, _rows``: for each distinct key under a target, the lengths of the prefixes that it is under,
    and the number of its rows.
    ``lengths`` are those that targets have here, behind their bucket's name and its ``NAME_DIGITS``.

    An interval join by a sweep. A target is the interval of the keys that begin with it, and intervals nest: in the
    order of keys, whatever a key is under also holds the last target before it. Keys and targets are cut into ranges by
    sampled splitters, so one target with much of the inventory lies in many ranges. The targets of each range are swept
    with a stack, which gives each the lengths of those that hold it; a range begins with those that hold its splitter.
    Then each key takes the last target before it in its range, and of its lengths those at which the two agree.
    """
    spark = df.sparkSession
    ship_package(spark)
    # bucket and key as one text, in which no bucket is the beginning of another
    name = F.concat(F.lpad(F.length("bucket").cast("string"), NAME_DIGITS, "0"), "bucket")
    narrow = df.select("bucket", "key").where("bucket is not null and key is not null").groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("_rows"))
    keys = stored(narrow.select("*", F.concat(name, "key").alias("address"), F.length(name).alias("skip")), "keys")
    sought = stored(wanted.select(F.concat(name, "target_prefix").alias("address")), "targets")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(keys.select("address").unionByName(sought), "address", RANGES_PER_PARTITION * partitions)
    # keys end at 1,024 bytes, so there are few lengths
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n < F.length("start"))
    begins = spark.createDataFrame(list(enumerate(["", *cuts])), "range int, start string")
    heads = begins.select("range", "start", F.explode(fitting).alias("n"))
    heads = heads.select("range", "n", F.substring("start", F.lit(1), F.col("n")).alias("address"))
    open_at: dict[int, list[int]] = {}
    # for each range, no more rows than targets nest
    for number, n in sorted(map(tuple, heads.join(sought, "address").select("range", "n").collect())):
        open_at.setdefault(number, []).append(n)
    starts = ["", *cuts]
    shared = spark.sparkContext.broadcast((starts, open_at))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, open_at = shared.value
        at, before, holders = None, "", []
        for batch in batches:
            chains = []
            for number, address in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != at:
                    at, before, holders = number, starts[number], list(open_at.get(number, ()))
                while holders and not address.startswith(before[: holders[-1]]):
                    holders.pop()
                holders.append(len(address))
                chains.append(list(holders))
                before = address
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chains, pa.list_(pa.int32()))], names=["range", "address", "holders"])

    ranged = sought.select(range_of(F.col("address"), cuts).cast("int").alias("range"), "address")
    swept = ranged.repartition("range").sortWithinPartitions("range", "address").mapInArrow(sweep, "range int, address string, holders array<int>")
    opening = spark.createDataFrame([(n, s, open_at.get(n, [])) for n, s in enumerate(starts)], swept.schema)
    none = F.lit(None)
    events = swept.select("*", F.lit(1).alias("kind"), none.cast("string").alias("bucket"), none.cast("string").alias("key"), none.cast("int").alias("skip"), none.cast("long").alias("_rows"))
    events = events.unionByName(opening.withColumn("kind", F.lit(0)), allowMissingColumns=True).unionByName(
        keys.select(range_of(F.col("address"), cuts).cast("int").alias("range"), "address", F.lit(2).alias("kind"), "bucket", "key", "skip", "_rows"),
        allowMissingColumns=True,
    )
    so_far = Window.partitionBy("range").orderBy("address", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") < 2, F.struct("address", "holders")), ignorenulls=True).over(so_far)
    met = events.withColumn("last", last).where(F.col("kind") == 2)
    begin = lambda text, n: F.substring(text, F.lit(1), n)
    agreed = F.filter("last.holders", lambda n: begin(F.col("address"), n) == begin(F.col("last.address"), n))
    found = met.select("bucket", "key", F.transform(agreed, lambda n: n - F.col("skip")).alias("_lengths"), "_rows")
    return found.where(F.size("_lengths") > 0)
