"""Row filters. Directory rows pass all of them; delete markers pass those about stored bytes."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from bucketscope.functions.regex import compile_pattern, to_java
from bucketscope.functions.scalars import parse_size
from bucketscope.schema import DELETE_MARKER, OBJECT, PREFIX

# Storage classes.
STORAGE_CLASSES = (
    "STANDARD",
    "REDUCED_REDUNDANCY",
    "STANDARD_IA",
    "ONEZONE_IA",
    "INTELLIGENT_TIERING",
    "GLACIER",
    "DEEP_ARCHIVE",
    "GLACIER_IR",
    "EXPRESS_ONEZONE",
    "OUTPOSTS",
    "SNOW",
    "FSX_OPENZFS",
    "FSX_ONTAP",
)


@dataclass(frozen=True)
class FilterConfig:
    """Filters to apply; sizes are bytes or text such as ``8MiB``, times are UTC unless they carry a zone."""

    include_regex: str | None = None
    exclude_regex: str | None = None
    mtime_before: dt.datetime | None = None
    mtime_after: dt.datetime | None = None
    smaller_size: int | str | None = None
    larger_size: int | str | None = None
    storage_class: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        """A malformed pattern is refused here, before any row is read."""
        for pattern in (self.include_regex, self.exclude_regex):
            if pattern is not None:
                compile_pattern(pattern)

    def key_head(self) -> str | None:
        """Text that every key passing the patterns begins with, where one can be told."""
        return compile_pattern(self.include_regex).begins if self.include_regex else None

    def key_texts(self) -> list[Column]:
        """Tests for the text that every key passing the patterns holds; unlike a pattern, they reach the scan."""
        if not self.include_regex:
            return []
        found, key = compile_pattern(self.include_regex), F.col("key")
        tests = [key.startswith(found.begins)] if found.begins else []
        tests += [key.endswith(found.ends)] if found.ends else []
        return tests + [key.contains(text) for text in found.holds[:1]]

    @staticmethod
    def instant(when: dt.datetime) -> Column:
        return F.lit(when if when.tzinfo else when.replace(tzinfo=dt.timezone.utc))

    @staticmethod
    def size_value(size: int | str) -> Column:
        amount = parse_size(size) if isinstance(size, str) else size
        # sizes in tables are signed 64-bit, so any larger bound compares as the largest decimal would
        return F.lit(amount) if amount < 2**63 else F.lit(str(amount)).cast("decimal(20,0)")

    def predicates(self) -> dict[str, Column]:
        """One test per given filter, by name, in the order they are applied; directory rows are not considered."""
        marker = F.col("entry_type") == DELETE_MARKER
        tests: dict[str, Column] = {}
        if self.include_regex is not None:
            tests["include_regex"] = F.col("key").rlike(to_java(self.include_regex))
        if self.exclude_regex is not None:
            tests["exclude_regex"] = ~F.col("key").rlike(to_java(self.exclude_regex))
        if self.mtime_before is not None:
            tests["mtime_before"] = F.col("last_modified") < self.instant(self.mtime_before)
        if self.mtime_after is not None:
            tests["mtime_after"] = F.col("last_modified") >= self.instant(self.mtime_after)
        if self.smaller_size is not None:
            tests["smaller_size"] = marker | (F.col("size") < self.size_value(self.smaller_size))
        if self.larger_size is not None:
            tests["larger_size"] = marker | (F.col("size") >= self.size_value(self.larger_size))
        if self.storage_class is not None:
            tests["storage_class"] = marker | _class_in(self.storage_class)
        return tests

    def predicate(self) -> Column:
        """All filters as one condition.

        Directory rows pass both parts. They are told apart in two ways, because the optimizer merges alternatives that
        share a side, and one with a pattern in it would keep the other filters from the scan.
        """
        kind = F.col("entry_type")
        tests = self.predicates()
        patterns = [tests.pop(name) for name in ("include_regex", "exclude_regex") if name in tests]
        comparisons = list(tests.values())
        comparisons += self.key_texts()
        condition = F.lit(True)
        if comparisons:
            condition = (kind == PREFIX) | reduce(and_, comparisons)
        if patterns:
            condition = condition & (((kind != OBJECT) & (kind != DELETE_MARKER)) | reduce(and_, patterns))
        return condition


def _class_in(classes: tuple[str, ...]) -> Column:
    unknown = [c for c in classes if c not in STORAGE_CLASSES]
    if unknown:
        raise ValueError(f"invalid storage class {unknown}; known: {', '.join(STORAGE_CLASSES)}")
    listed = F.col("storage_class").isin(list(classes))
    return F.col("storage_class").isNull() | listed if "STANDARD" in classes else listed


def apply_filters(df: DataFrame, config: FilterConfig) -> DataFrame:
    return df.filter(config.predicate())


def hide_delete_markers(df: DataFrame) -> DataFrame:
    return df.filter(F.col("entry_type") != DELETE_MARKER)


def first_rejection(config: FilterConfig) -> Column:
    """Name of the first filter that drops a row; NULL for rows that stay."""
    name = F.when(F.col("entry_type") == PREFIX, F.lit(None).cast("string"))
    for filter_name, test in config.predicates().items():
        name = name.when(~F.coalesce(test, F.lit(False)), F.lit(filter_name))
    return name


def rejections(df: DataFrame, config: FilterConfig) -> DataFrame:
    """Dropped rows per filter, each row counted for the filter that dropped it first."""
    named = df.select(first_rejection(config).alias("filter"), F.col("size"))
    return named.filter(F.col("filter").isNotNull()).groupBy("filter").agg(F.count("*").alias("dropped"))


def observe_rejections(df: DataFrame, config: FilterConfig, name: str | Observation = "rejections") -> DataFrame:
    """The filtered rows, with drops per filter reported as metrics of the same run (see ``DataFrame.observe``)."""
    filter_names = list(config.predicates())
    if not filter_names:
        return df
    marked = df.withColumn("_dropped_by", first_rejection(config))
    counts = [F.count_if(F.col("_dropped_by") == f).alias(f) for f in filter_names]
    return marked.observe(name, *counts).filter(F.col("_dropped_by").isNull()).drop("_dropped_by")
