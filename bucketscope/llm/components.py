"""Connected components over a table of links, and values brought back from groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketscope.llm.common import HOT_SHARE, stored


def hot_size(rows: int) -> int:
    """Rows from which a group counts as hot: at most ``HOT_SHARE`` groups can have so many."""
    return max(64, -(-rows // HOT_SHARE))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group. ``groups`` has one row per key, with the number of its rows in ``size``.

    Hot groups are few, by their size, and are broadcast; all others are joined by key, where no key has many rows.
    ``rows`` and ``groups`` should be stored tables, as both are read twice. Rows without a group are left out.
    """
    hot = F.col(size) >= hot_size(total)
    few = F.broadcast(groups.where(hot))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(groups.where(hot).select(*keys)), keys, "left_anti").join(groups.where(~hot), keys))


def _least_neighbours(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    least = both.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("links"))
    return both, stored(least.withColumn("least", F.least("a", "least")), "least")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a``, ``b``: long); a component is named by its least node.

    Each round first links all larger neighbours of a node to its least neighbour (large star), then all smaller ones
    (small star), until nothing changes; the number of rounds grows with the logarithm of the longest chain. Nodes with
    very many links are few and their least neighbours are broadcast.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = None
    while True:
        both, least = _least_neighbours(now)
        total = both.count()
        large = join_groups(both, least, ["a"], "links", total).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = stored(large.where("a <> b").distinct(), "stars")
        down = now.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("links"))
        joined = join_groups(now, stored(down, "least"), ["a"], "links", max(1, total))
        small = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            joined.select("a", F.col("least").alias("b"))
        )
        now = stored(small.where("a <> b").distinct(), "stars")
        was, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == state:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
