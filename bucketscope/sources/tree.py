"""Live listings of a directory tree or object store, as a data source and as a distributed walk.

Spark's file sources leave out names that start with ``_`` or ``.``, so they cannot list a tree completely.

``object_tree`` is a data source with one task per share of the top directories, and the function that reads it. It takes
filters: a key prefix or range and a depth decide which directories are opened at all, so such a listing stops early.

``walk_tree`` is for trees of any size. A frontier table holds the directories still to be opened. In each pass, tasks
take their share of it and go down as far as their budget of entries allows; what they leave is the frontier of the next
pass, dealt out anew. Budgets grow from pass to pass, so deep chains take few passes and wide trees are spread at once.
The files of a very large directory are dealt out by ranges of their names before they are looked at.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

from bucketscope.schema import OBJECT, PREFIX
from bucketscope.session import scratch, ship_package

BATCH_ROWS = 10_000
TREE_SCHEMA = "key string, size bigint, last_modified timestamp, entry_type string, key_depth int"
_ARROW_SCHEMA = pa.schema([
    ("key", pa.string()), ("size", pa.int64()), ("last_modified", pa.timestamp("us", "UTC")),
    ("entry_type", pa.string()), ("key_depth", pa.int32()),
])

#: Entries a task of the first pass of a walk looks at before it leaves directories to others, and how that grows.
FIRST_BUDGET = 20_000
BUDGET_GROWTH = 4
MOST_BUDGET = 20_000_000
#: Files of one directory that the task which reads it looks at itself, and files a task looks at of what is dealt out.
FLAT_FILES = 50_000
NAMES_PER_TASK = 100_000
WALK_TASKS = 256

#: kinds of rows of a pass, beside OBJECT and PREFIX: a directory still to be opened, a file still to be looked at
_FRONTIER = "FRONTIER"
_NAME = "NAME"

Connect = Callable[[str], tuple[fs.FileSystem, str]]


class Entry(NamedTuple):
    key: str
    is_directory: bool
    size: int | None = None
    mtime_us: int | None = None


class Store:
    """Entries below a path: a directory that all machines see, or a URI of one of Arrow's file systems.

    ``connect`` makes the file system and the root there from the path, in place of Arrow's own choice.
    """

    def __init__(self, path: str, connect: Connect | None = None):
        local = path.removeprefix("file://").removeprefix("file:")
        self.local = connect is None and local.startswith("/")
        if self.local:
            self.root = local.rstrip("/")
        else:
            self.system, root = (connect or fs.FileSystem.from_uri)(path)
            self.root = root.rstrip("/")

    def entries(self, prefix: str, most_files: int | None = None) -> Iterator[Entry]:
        """Entries of one directory, named by its keys' prefix. Of the files after the first ``most_files`` of a mounted
        directory only the names are read. What vanishes while it is listed is left out."""
        if not self.local:
            yield from self._listed(prefix)
            return
        try:
            scan = os.scandir(f"{self.root}/{prefix}")
        except (FileNotFoundError, NotADirectoryError):
            return
        files = 0
        with scan:
            for entry in scan:
                if entry.is_dir(follow_symlinks=False):
                    yield Entry(f"{prefix}{entry.name}/", True)
                    continue
                files += 1
                if most_files is not None and files > most_files:
                    yield Entry(prefix + entry.name, False)
                elif found := self.file(prefix + entry.name):
                    yield found

    def file(self, key: str) -> Entry | None:
        try:
            status = os.stat(f"{self.root}/{key}", follow_symlinks=False)
        except (FileNotFoundError, NotADirectoryError):
            return None
        return Entry(key, False, status.st_size, status.st_mtime_ns // 1000)

    def _listed(self, prefix: str) -> Iterator[Entry]:
        """Names are taken from whole paths: an object may be called like the directory that it marks (``photos/``), and a
        directory may have an empty name (``a//b``)."""
        base = f"{self.root}/{prefix}"[:-1] if prefix else self.root
        for info in self.system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            key = prefix + info.path[len(base) :].removeprefix("/")
            if info.type == fs.FileType.Directory:
                yield Entry(f"{key}/", True)
            elif info.type == fs.FileType.File:
                yield Entry(key, False, info.size or 0, (info.mtime_ns or 0) // 1000)


def key_depth(key: str) -> int:
    return key.removesuffix("/").count("/") + 1


def start_of(prefix: str) -> str:
    """The directory in which a listing of ``prefix`` begins."""
    return prefix[: prefix.rfind("/") + 1]


@dataclass(frozen=True)
class Bounds:
    """What a listing asks for, as conditions on keys, depths and sizes, all of which must hold.

    Keys compare by code point, the order of their UTF-8 bytes.
    """

    prefix: str = ""
    least: str = ""
    above: str | None = None
    most: str | None = None
    below: str | None = None
    least_depth: int = 0
    most_depth: int | None = None
    least_size: int = 0
    most_size: int | None = None

    def may_hold(self, directory: str) -> bool:
        """Whether any key below ``directory`` (which ends in a slash, or is the root) can be asked for."""
        if not (directory.startswith(self.prefix) or self.prefix.startswith(directory)):
            return False
        if self.most_depth is not None and directory.count("/") + 1 > self.most_depth:
            return False
        if any(low > directory and not low.startswith(directory) for low in (self.least, self.above or "")):
            return False
        # every key below the directory is at least its prefix
        return (self.most is None or directory <= self.most) and (self.below is None or directory < self.below)

    def holds(self, key: str, size: int | None = None) -> bool:
        """Whether a key, and its size where it is known, is asked for."""
        depth = key_depth(key)
        return (
            key.startswith(self.prefix)
            and key >= self.least
            and (self.above is None or key > self.above)
            and (self.most is None or key <= self.most)
            and (self.below is None or key < self.below)
            and depth >= self.least_depth
            and (self.most_depth is None or depth <= self.most_depth)
            and (size is None or (size >= self.least_size and (self.most_size is None or size <= self.most_size)))
        )

    def narrowed(self, wanted: Filter) -> "Bounds | None":
        """These bounds and a filter of Spark's, or None for one that they cannot express."""
        if isinstance(wanted, IsNotNull):
            return self if wanted.attribute in (("key",), ("size",), ("key_depth",), ("entry_type",)) else None
        value = getattr(wanted, "value", None)
        if value is None:
            return None
        if wanted.attribute == ("key",):
            return self._key(wanted, value)
        if wanted.attribute in (("key_depth",), ("size",)):
            name = "depth" if wanted.attribute == ("key_depth",) else "size"
            low, high = _whole_range(wanted, value)
            if low is None and high is None:
                return None
            return self._range(name, low, high)
        return None

    def _key(self, wanted: Filter, value: str) -> "Bounds | None":
        if isinstance(wanted, StringStartsWith):
            if value.startswith(self.prefix):
                return replace(self, prefix=value)
            return self if self.prefix.startswith(value) else replace(self, least="\U0010ffff", below="")
        if isinstance(wanted, EqualTo):
            return replace(self, least=max(self.least, value), most=value if self.most is None else min(self.most, value))
        if isinstance(wanted, GreaterThanOrEqual):
            return replace(self, least=max(self.least, value))
        if isinstance(wanted, GreaterThan):
            return replace(self, above=value if self.above is None else max(self.above, value))
        if isinstance(wanted, LessThanOrEqual):
            return replace(self, most=value if self.most is None else min(self.most, value))
        if isinstance(wanted, LessThan):
            return replace(self, below=value if self.below is None else min(self.below, value))
        return None

    def _range(self, name: str, low: int | None, high: int | None) -> "Bounds":
        least, most = getattr(self, f"least_{name}"), getattr(self, f"most_{name}")
        if low is not None:
            least = max(least, low)
        if high is not None:
            most = high if most is None else min(most, high)
        return replace(self, **{f"least_{name}": least, f"most_{name}": most})


def _whole_range(wanted: Filter, value: int) -> tuple[int | None, int | None]:
    if isinstance(wanted, EqualTo):
        return value, value
    if isinstance(wanted, GreaterThan):
        return value + 1, None
    if isinstance(wanted, GreaterThanOrEqual):
        return value, None
    if isinstance(wanted, LessThan):
        return None, value - 1
    if isinstance(wanted, LessThanOrEqual):
        return None, value
    return None, None


@dataclass
class TreePart(InputPartition):
    """Prefixes one task lists, each with whether it lists all that is below or only the files directly in it."""

    prefixes: list[tuple[str, bool]]


class ObjectTreeSource(DataSource):
    """Options: ``path`` (a directory all executors see, or a URI of one of Arrow's file systems), ``prefix`` (a literal
    key prefix), ``max_depth`` (levels below the prefix's directory to list; directories at the last one become PREFIX
    rows and are not opened), ``depth`` (levels of directories that the driver opens to split the work, default 1: the one
    directory in which the listing begins) and ``tasks`` (most tasks to share them among, default 1024).

    Through :func:`object_tree`, filters are applied by the source.
    """

    @classmethod
    def name(cls) -> str:
        return "object_tree"

    def schema(self) -> str:
        return TREE_SCHEMA

    def reader(self, schema) -> "ObjectTreeReader":
        depth, tasks = int(self.options.get("depth", 1)), int(self.options.get("tasks", 1024))
        levels = self.options.get("max_depth")
        kind = PushingTreeReader if self.options.get("pushed") == "true" else ObjectTreeReader
        return kind(self.options["path"], depth, tasks, self.options.get("prefix", ""), int(levels) if levels else None)


class ObjectTreeReader(DataSourceReader):
    def __init__(self, path: str, depth: int, tasks: int, prefix: str = "", max_depth: int | None = None):
        if depth < 0 or tasks < 1 or (max_depth is not None and max_depth < 1):
            raise ValueError("depth must not be negative, tasks and max_depth must be positive")
        self.path = path
        self.depth = depth
        self.tasks = tasks
        self.bounds = Bounds(prefix)
        self.last = None if max_depth is None else start_of(prefix).count("/") + max_depth

    def _folds(self, directory: str) -> bool:
        """Whether a directory is shown as one row."""
        return self.last is not None and directory.count("/") >= self.last

    def partitions(self) -> list[TreePart]:
        store = Store(self.path)
        start = start_of(self.bounds.prefix)
        level = [start] if self.bounds.may_hold(start) else []
        shares: list[tuple[str, bool]] = []
        for _ in range(self.depth):
            shares += [(prefix, False) for prefix in level]
            level = [
                e.key for prefix in level for e in store.entries(prefix, 0)
                if e.is_directory and not self._folds(e.key) and self.bounds.may_hold(e.key)
            ]
        shares += [(prefix, True) for prefix in level]
        return [TreePart(shares[n :: self.tasks]) for n in range(min(self.tasks, len(shares)))]

    def _rows(self, store: Store, prefix: str, recursive: bool) -> Iterator[tuple]:
        pending = [prefix]
        while pending:
            for entry in store.entries(pending.pop()):
                if not entry.is_directory:
                    if self.bounds.holds(entry.key, entry.size):
                        yield _file_row(entry)
                elif self._folds(entry.key):
                    if self.bounds.holds(entry.key, 0):
                        yield _prefix_row(entry.key)
                elif recursive and self.bounds.may_hold(entry.key):
                    pending.append(entry.key)

    def read(self, partition: TreePart) -> Iterator[pa.RecordBatch]:
        store = Store(self.path)
        yield from _batches(row for prefix, recursive in partition.prefixes for row in self._rows(store, prefix, recursive))


class PushingTreeReader(ObjectTreeReader):
    """A reader that takes filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for wanted in filters:
            narrowed = self.bounds.narrowed(wanted)
            if narrowed is not None:
                self.bounds = narrowed
                continue
            if isinstance(wanted, In) and wanted.attribute == ("key",) and wanted.value:
                # all that is between the outermost is read, and Spark picks
                kept = [v for v in wanted.value if v is not None]
                self.bounds = replace(self.bounds, least=max(self.bounds.least, min(kept, default="")))
                self.bounds = self.bounds._key(LessThanOrEqual(("key",), max(kept)), max(kept)) if kept else self.bounds
            yield wanted


def _file_row(entry: Entry) -> tuple:
    return entry.key, entry.size, entry.mtime_us, OBJECT, key_depth(entry.key)


def _prefix_row(key: str) -> tuple:
    return key, 0, None, PREFIX, key_depth(key)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, type=field.type) for values, field in zip(zip(*rows), _ARROW_SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW_SCHEMA)


def register(spark: SparkSession) -> None:
    """Make the format ``object_tree`` known."""
    spark.dataSource.register(ObjectTreeSource)


def object_tree(
    spark: SparkSession, path: str, prefix: str = "", max_depth: int | None = None, depth: int = 1, tasks: int = 1024
) -> DataFrame:
    """A listing of the tree at ``path`` (``TREE_SCHEMA``; for the options see :class:`ObjectTreeSource`) that takes filters.

    Those on ``key`` (prefix, equality, range), ``key_depth`` and ``size`` leave Spark's plan for the source, and the
    first two keep directories that cannot match from being opened.

    Spark 4.1 keeps what was pushed with the loaded source until the next query that pushes something, so a query without
    filters would get the rows of the one before it. The condition added here is always true and is pushed by every
    query. A plain ``spark.read.format("object_tree")`` takes no filters, for the same reason.
    """
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": path, "prefix": prefix, "depth": depth, "tasks": tasks, "pushed": "true"}
    if max_depth is not None:
        options["max_depth"] = max_depth
    return spark.read.format("object_tree").options(**options).load().where(F.col("key_depth") >= 1)


def walk_tree(
    spark: SparkSession,
    path: str,
    prefix: str = "",
    max_depth: int | None = None,
    tasks: int = WALK_TASKS,
    connect: Connect | None = None,
    first_budget: int = FIRST_BUDGET,
    flat_files: int = FLAT_FILES,
) -> DataFrame:
    """A complete listing of the tree at ``path`` (``TREE_SCHEMA``), by passes of tasks over a frontier of directories.

    ``prefix`` is a literal key prefix; directories outside it are not opened. With ``max_depth``, the directories that
    many levels below the prefix's own become PREFIX rows and are not opened. The driver opens no directory. Each pass
    is written to the shared scratch folder, so a lost executor costs the directories of its tasks in one pass only.

    Files and directories that vanish during the walk are left out. On a mounted directory, links are listed as files and
    not followed. On Arrow file systems a marker object (``photos/``) and keys with ``//`` are listed as the file system
    reports them. ``connect`` is as for :class:`Store`.
    """
    if max_depth is not None and max_depth < 1:
        raise ValueError("max_depth must be positive")
    ship_package(spark)
    bounds, start = Bounds(prefix), start_of(prefix)
    last = None if max_depth is None else start.count("/") + max_depth
    folder = scratch(spark, "tree")
    frontier, waiting, budget, passes = spark.createDataFrame([(start,)], "key string"), 1, first_budget, []
    while waiting:
        passes.append(f"{folder}/pass={len(passes)}")
        shares = min(tasks, waiting)
        dealt = frontier.repartition(shares) if waiting > 1 else frontier
        dealt.mapInArrow(_opened(path, connect, bounds, last, budget, flat_files), TREE_SCHEMA).write.parquet(passes[-1])
        frontier = spark.read.schema(TREE_SCHEMA).parquet(passes[-1]).where(F.col("entry_type") == _FRONTIER).select("key")
        waiting = frontier.count()
        budget = min(budget * BUDGET_GROWTH, MOST_BUDGET)
    rows = spark.read.schema(TREE_SCHEMA).parquet(*passes)
    names = rows.where(F.col("entry_type") == _NAME).select("key")
    listed = rows.where(F.col("entry_type").isin(OBJECT, PREFIX))
    unseen = names.count()
    if unseen:
        seen = f"{folder}/names"
        ranges = names.repartitionByRange(min(tasks, -(-unseen // NAMES_PER_TASK)), "key")
        ranges.mapInArrow(_looked_at(path), TREE_SCHEMA).write.parquet(seen)
        listed = listed.unionByName(spark.read.schema(TREE_SCHEMA).parquet(seen))
    return listed


def _opened(path: str, connect: Connect | None, bounds: Bounds, last: int | None, budget: int, flat_files: int):
    """A task of a pass: rows for the files of its directories and, within its budget, of those below."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, spent = Store(path, connect), 0
        for batch in batches:
            for given in batch.column(0).to_pylist():
                pending = deque([given])
                # the first directory is opened whatever it costs, so that each pass gets on
                while pending and (spent == 0 or spent < budget):
                    spent += 1
                    for entry in store.entries(pending.popleft(), flat_files):
                        spent += 1
                        if not entry.is_directory:
                            if bounds.holds(entry.key):
                                yield _file_row(entry) if entry.size is not None else (entry.key, None, None, _NAME, 0)
                        elif last is not None and entry.key.count("/") >= last:
                            if bounds.holds(entry.key):
                                yield _prefix_row(entry.key)
                        elif bounds.may_hold(entry.key):
                            pending.append(entry.key)
                for left in pending:
                    yield left, None, None, _FRONTIER, 0

    return lambda batches: _batches(rows(batches))


def _looked_at(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store = Store(path)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                if found := store.file(key):
                    yield _file_row(found)

    return lambda batches: _batches(rows(batches))
