"""Directory counts that are kept up to date by deltas, in place of a count over every inventory.

The table holds rows per directory as they lie (``prefix_counts``), in folders of one delta each: what was added counts up,
what was removed counts down. Counts add, so levels above, whole directories that vanish, and deltas in any order follow
from one aggregation over the folders. A delta has an identifier and its own folder, so one that is applied again replaces
itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.operators.hierarchy import DISCOVERY_DEPTH, ancestors, prefix_counts

COUNTS = ("objects", "size", "markers")
COUNTS_SCHEMA = "bucket string, prefix string, level int, objects bigint, size bigint, markers bigint"
SETTINGS_SCHEMA = "prefix string, depth int"


class PrefixTable:
    """Counts per directory under ``prefix``, down to ``depth`` levels, below a path that all machines share."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = "", depth: int = DISCOVERY_DEPTH):
        if depth < 1:
            raise ValueError("depth must be at least 1")
        self.spark, self.path, self.prefix, self.depth = spark, path.rstrip("/"), prefix, depth
        paths = spark._jvm.org.apache.hadoop.fs.Path
        self._at = lambda name: paths(f"{self.path}/{name}")
        self.system = paths(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.system.exists(self._at("settings/_SUCCESS")):
            found = tuple(spark.read.schema(SETTINGS_SCHEMA).parquet(f"{self.path}/settings").first())
            if found != (prefix, depth):
                raise ValueError(f"{path} counts directories under {found[0]!r} to depth {found[1]}")
        else:
            spark.createDataFrame([(prefix, depth)], SETTINGS_SCHEMA).write.mode("overwrite").parquet(f"{self.path}/settings")

    def _folders(self) -> list[str]:
        if not self.system.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self.system.listStatus(self._at(""))]
        return sorted(n for n in names if n.startswith("delta-") and self.system.exists(self._at(f"{n}/_SUCCESS")))

    def apply(self, delta: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Count the rows of an inventory that came and those that went, under the identifier ``delta``."""
        if "/" in delta or not delta:
            raise ValueError("a delta's identifier must not be empty or hold a slash")
        counted = self.spark.createDataFrame([], COUNTS_SCHEMA)
        for rows, sign in ((added, 1), (removed, -1)):
            if rows is not None:
                counts = prefix_counts(rows, self.prefix, self.depth)
                counted = counted.unionByName(counts.withColumns({c: F.col(c) * sign for c in COUNTS}))
        counted.write.mode("overwrite").parquet(f"{self.path}/delta-{delta}")

    def rows(self) -> DataFrame:
        """Counts per directory that a key lies in, over all deltas; directories without any are gone."""
        folders = [f"{self.path}/{n}" for n in self._folders()]
        found = self.spark.read.schema(COUNTS_SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], COUNTS_SCHEMA)
        summed = found.groupBy("bucket", "prefix", "level").agg(*[F.sum(c).alias(c) for c in COUNTS])
        return summed.where((F.col("objects") != 0) | (F.col("markers") != 0))

    def merge(self, into: str) -> None:
        """Make one delta, ``into``, of all there are. Their identifiers can then no longer be applied again.

        The merged folder is complete before the others go, and gets its name when they are gone, so nobody may read
        meanwhile; a merge that was cut off in between is finished by :meth:`finish_merge`.
        """
        old = [n for n in self._folders() if n != f"delta-{into}"]
        if f"delta-{into}" in self._folders():
            raise ValueError(f"there is a delta {into!r} already")
        self.rows().write.mode("overwrite").parquet(f"{self.path}/merging-{into}")
        self.spark.createDataFrame([(n,) for n in old], "folder string").write.mode("overwrite").parquet(f"{self.path}/merged-{into}")
        self.finish_merge(into)

    def finish_merge(self, into: str) -> None:
        """Put the merged folder in place of those it was made from; can be repeated."""
        for (folder,) in self.spark.read.schema("folder string").parquet(f"{self.path}/merged-{into}").collect():
            self.system.delete(self._at(folder), True)
        if self.system.exists(self._at(f"merging-{into}")):
            self.system.rename(self._at(f"merging-{into}"), self._at(f"delta-{into}"))
        self.system.delete(self._at(f"merged-{into}"), True)

    def discover(self) -> DataFrame:
        """As :func:`~bucketscope.operators.hierarchy.discover_prefixes` over the inventory that the deltas make up."""
        at = F.explode(ancestors(F.col("prefix"), self.prefix, F.col("level"), 1)).alias("at")
        above = self.rows().select("bucket", at, "objects", "size")
        return above.groupBy("bucket", "at.level", "at.prefix").agg(
            F.sum("objects").alias("object_count"), F.sum("size").alias("total_size")
        )
