"""Session settings and shared scratch folders."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or holds at once, and bytes of stored files that it reads before a shuffle.
ROWS_PER_TASK = 200_000
BYTES_PER_TASK = 16 << 20


def build_session(app: str = "bucketscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting that holds for what is run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of so many rows: as the session has them, or more, so that none grows with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))


@contextmanager
def small_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside shuffles ``rows`` rows in tasks of bounded size, on both sides of the shuffle, so that they need not
    spill however large the table is."""
    split = "spark.sql.files.maxPartitionBytes"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(split))
    held = {split: str(min(now, BYTES_PER_TASK)), "spark.sql.shuffle.partitions": str(partitions_for(spark, rows))}
    if rows > ROWS_PER_TASK:
        # adaptive execution merges partitions by compressed bytes, of which narrow rows have few
        held["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
    with ExitStack() as stack:
        for name, value in held.items():
            stack.enter_context(setting(spark, name, value))
        yield


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver found it; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="bucketscope-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where none is set, a local master gets a temporary one; a cluster
    raises, as its machines do not share temporary folders."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not is_local(context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="bucketscope-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, which every executor can reach."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once below the checkpoint folder and read back: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
