"""A hot key, target or group is shared among tasks. Adaptive execution is off here, so that nothing is put together."""

import pytest
from pyspark.sql import functions as F

from bucketscope.operators.hierarchy import prefix_counts, repartition_by_prefix
from bucketscope.operators.sorting import sort_listing
from bucketscope.plans.skew import previous_values
from bucketscope.schema import LISTING_SCHEMA
from bucketscope.sources.targets import under_targets

N = 20_000


@pytest.fixture
def fixed(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def hot_inventory(spark):
    """Half of the rows are versions of one key."""
    known = {
        "bucket": F.lit("hot"),
        "entry_type": F.lit("OBJECT"),
        "key": F.when(F.col("id") % 2 == 0, "data/a/hot").otherwise(F.concat(F.lit("data/b/"), F.col("id"))),
        "size": F.lit(7),
        "version_id": F.concat(F.lit("v"), F.col("id")),
    }
    return spark.range(N).select(
        [known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LISTING_SCHEMA.fields]
    )


def largest_share(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(counts) == N
    return max(counts) / N


def test_ranges_split_a_hot_key(fixed):
    df = hot_inventory(fixed)
    assert largest_share(repartition_by_prefix(df, 8)) < 0.25
    assert largest_share(sort_listing(df, ["key"])) < 0.25
    assert largest_share(sort_listing(df, ["size"])) < 0.25


def test_shuffled_targets_split_a_hot_target(fixed):
    targets = fixed.createDataFrame([("hot", "data/")], "bucket string, prefix string")
    found = under_targets(hot_inventory(fixed), targets, broadcast_bytes=0)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert largest_share(found) < 0.5


def test_chunks_split_a_hot_group(fixed):
    pages = fixed.range(N).selectExpr("'hot' as g", "id", "id % 5 as token")
    assert largest_share(previous_values(pages, ["g"], "id", ["token"], chunk=256)) < 0.3


def test_counts_are_reduced_before_the_shuffle(fixed):
    plan = prefix_counts(hot_inventory(fixed), "", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("partial_sum")
