"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bucketscope.session import scratch, ship_package

#: Join keys a broadcast may hold: rows of a table of groups that each hold at least this share of all rows.
HOT_SHARE = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows written once to the shared scratch folder and read back: lineage ends there, and a lost executor costs
    nothing but a new read."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def in_python(df: DataFrame) -> DataFrame:
    """``df``, once the Python workers that will see its rows can import this package."""
    ship_package(df.sparkSession)
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(columns: Sequence[str], name: str) -> str:
    """``name``, or the first of its variants that no input column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def running_total(
    df: DataFrame, group: Sequence[str], chunk: str, order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """The sum of ``value`` over the rows before this one within ``group``, in the order of ``chunk``, then ``order``.

    A group is handled chunk by chunk: the totals of the chunks, one row per group and chunk, give each chunk its
    offset, and only the rows of one chunk are ordered together. Rows that tie in every order column must be
    interchangeable. Group columns must not be null.
    """
    keys = [*group, chunk]
    summed = df.groupBy(*keys).agg(F.sum(value).alias("_in_chunk"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = summed.select(*keys, F.coalesce(F.sum("_in_chunk").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = ranked.join(offsets.hint("merge"), keys)
    return joined.withColumn(name, F.col("_within") + F.col("_offset")).drop("_within", "_offset")
