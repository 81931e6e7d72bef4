"""Range partitions by splitters that the driver knows, for sweeps in which each range is worked on by itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketscope.session import partitions_for

#: Sampled rows per range, which bounds what comes to the driver.
SAMPLES_PER_RANGE = 20


def splitters(df: DataFrame, column: str, ranges: int, seed: int = 7, total: int | None = None) -> list[str]:
    """Values that cut the rows into at most ``ranges`` about equal ranges of a string column, from a sample. A range begins
    at a splitter; the first begins at the smallest value of all. Equal values are never cut apart. ``total`` is the number
    of rows, where it is known."""
    total = df.count() if total is None else total
    if total < 2 or ranges < 2:
        return []
    share = min(1.0, ranges * SAMPLES_PER_RANGE / total)
    sample = sorted(row[0] for row in df.select(column).sample(False, share, seed).collect())
    return sorted({sample[len(sample) * n // ranges] for n in range(1, ranges)}) if sample else []


def range_of(value: Column, cuts: list[str]) -> Column:
    """How many splitters are not above the value: its range, from 0. A coarse and a fine look-up, inside the stage."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[n : n + step] for n in range(0, len(cuts), step)]
    first = F.lit([b[0] for b in blocks]).cast("array<string>")
    block = F.size(F.filter(first, lambda s: s <= value)) - 1
    inside = F.get(F.lit(blocks).cast("array<array<string>>"), block)
    return F.when(block < 0, 0).otherwise(block * step + F.size(F.filter(inside, lambda s: s <= value)))


def _in_order(value: Column) -> Column:
    """A text as part of a longer one that is in the order of its parts: no part is the beginning of another."""
    return F.concat(F.replace(F.coalesce(value, F.lit("")), F.lit("\x00"), F.lit("\x00\x01")), F.lit("\x00\x00"))


def instant_text(moment: Column) -> Column:
    """A timestamp as digits in its order; a null one first."""
    micros = F.unix_micros(moment) + F.lit(1 << 62)
    return F.coalesce(F.lpad(micros.cast("string"), 19, "0"), F.lit(""))


def mark_last(
    df: DataFrame, group: Sequence[str | Column], order: Sequence[Column], name: str, ranges: int | None = None
) -> DataFrame:
    """The rows with ``name``: whether a row is the last of its group in the order of some texts.

    One exchange and no join. The rows are cut into ranges of group and order by splitters, so a group of any size is in as
    many ranges as it fills; each range is sorted, and a row looks at the one after it. The row after the last of a range is
    the splitter that begins the next: a splitter is a row of the table. The result is sorted, a partition per range, in the
    order of the ranges. Null group values count as empty. Rows equal in group and order are marked together or one by one,
    as they come.

    Only the columns of ``df`` and the range are shuffled: the texts of group and order are made again behind the exchange.
    Without ``ranges``, there are as many as hold about ``ROWS_PER_TASK`` rows each, so a task sorts no more when the table
    grows; and the rows that look at each other are those of a group, so no range is held a second time.
    """
    spark = df.sparkSession
    total = df.count()
    ranges = ranges or partitions_for(spark, total)
    whole = F.concat(*[_in_order(F.col(g) if isinstance(g, str) else g) for g in group])
    rest = F.concat(*[_in_order(o) for o in order])
    placed = df.select("*", F.concat(whole, rest).alias("_address"))
    cuts = splitters(placed, "_address", ranges, total=total)
    ranged = placed.withColumn("_range", range_of(F.col("_address"), cuts).cast("int")).drop("_address")
    ranged = ranged.repartitionById(len(cuts) + 1, "_range").withColumns({"_group": whole, "_rest": rest})
    along = Window.partitionBy("_range", "_group").orderBy("_rest")
    next_range = F.coalesce(F.get(F.lit(cuts).cast("array<string>"), F.col("_range")), F.lit(""))
    last = F.lead("_rest").over(along).isNull() & ~next_range.startswith(F.col("_group"))
    return ranged.withColumn(name, last).drop("_group", "_rest", "_range")
