"""Totals over listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.schema import DELETE_MARKER, OBJECT


def total_columns() -> list[Column]:
    """Objects (every version is one), their bytes, and delete markers; directories do not count."""
    is_object = F.col("entry_type") == OBJECT
    return [
        F.count_if(is_object).alias("total_objects"),
        F.coalesce(F.sum(F.when(is_object, F.col("size"))), F.lit(0).cast("bigint")).alias("total_size"),
        F.count_if(F.col("entry_type") == DELETE_MARKER).alias("total_delete_markers"),
    ]


def summarize(df: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """One row of totals, or one per group. Groups are reduced within tasks before the shuffle."""
    return df.groupBy(*by).agg(*total_columns())


def with_summary(df: DataFrame) -> DataFrame:
    """Rows and their total in one table: ``section`` is 0 for rows and 1 for the total."""
    rows = df.withColumn("section", F.lit(0))
    total = summarize(df).withColumn("section", F.lit(1))
    return rows.unionByName(total, allowMissingColumns=True)
