"""Ordered computations that do not gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketscope.session import small_tasks, stored

CHUNK = 4096


def line_numbers(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Rows with their position in a total order, from 1.

    The sorted rows are numbered within range partitions and stored, so that the numbers stay with the rows when an
    executor is lost. There are as many partitions as hold a bounded number of rows. Only the row count per partition comes
    to the driver, to give each partition its offset.
    """
    spark = df.sparkSession
    with small_tasks(spark, df.count()):
        slotted = stored(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_slot", 33)
    sizes = slotted.groupBy(part.cast("int").alias("part")).count().collect()
    count_of = dict(sizes)
    offsets, total = [], 0
    for index in range(max(count_of, default=-1) + 1):
        offsets.append(total)
        total += count_of.get(index, 0)
    if not offsets:
        return slotted.select(*df.columns, F.lit(0).cast("bigint").alias(name))
    offset = F.get(F.lit(offsets).cast("array<bigint>"), part.cast("int"))
    in_part = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return slotted.select(*df.columns, (offset + in_part + 1).alias(name))


def previous_values(
    df: DataFrame, group: Sequence[str], order: str, columns: Sequence[str], chunk: int = CHUNK
) -> DataFrame:
    """``lag`` by one row over ``group`` ordered by a whole-number column, as ``previous_<column>``.

    Rows are handled in chunks of ``chunk`` consecutive numbers. The last row of each chunk, one in ``chunk`` where the
    numbers are dense, is all that is ordered per group to serve the first row of the chunk after it.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    # NULL group values are equal to each other, as in a window
    grouped = df.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(g)), F.lit("")) for k, g in zip(keys, group)})
    chunked = grouped.withColumn("_chunk", F.expr(f"`{order}` div {chunk}"))
    values = F.struct(*columns)
    edges = chunked.groupBy(*keys, "_chunk").agg(F.max_by(values, F.col(order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    edges = edges.select(*keys, "_chunk", F.lag("_last").over(across).alias("_edge"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(order)
    rows = chunked.withColumn("_previous", F.lag(values).over(within))
    joined = rows.join(edges, [*keys, "_chunk"])
    previous = F.coalesce("_previous", "_edge")
    return joined.select(*df.columns, *[previous[c].alias(f"previous_{c}") for c in columns])
