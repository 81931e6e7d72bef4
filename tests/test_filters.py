import datetime as dt

import pytest
from conftest import DAY, UTC, keys, row

from bucketscope.operators.filters import (
    FilterConfig,
    apply_filters,
    hide_delete_markers,
    observe_rejections,
    rejections,
)

MARKER = {"entry_type": "DELETE_MARKER", "version_id": "m"}


@pytest.mark.parametrize(
    "pattern, kept",
    [(r"\.csv$", ["report.csv", "data.csv"]), (r"\.xlsx$", []), ("^(report|notes)", ["report.csv", "notes.md"])],
)
def test_include_and_exclude_regex(rows, pattern, kept):
    names = ["report.csv", "data.csv", "summary.txt", "archive.tar.gz", "notes.md"]
    df = rows(*[row(n) for n in names])
    assert keys(apply_filters(df, FilterConfig(include_regex=pattern))) == kept
    assert keys(apply_filters(df, FilterConfig(exclude_regex=pattern))) == [n for n in names if n not in kept]


SIZES = {"tiny.bin": 10, "small.bin": 1000, "medium.bin": 10000, "large.bin": 100000}


@pytest.mark.parametrize(
    "config, kept",
    [
        (FilterConfig(smaller_size=1000), ["tiny.bin"]),
        (FilterConfig(smaller_size="1KiB"), ["tiny.bin", "small.bin"]),
        (FilterConfig(larger_size=10000), ["medium.bin", "large.bin"]),
        (FilterConfig(larger_size="1KB", smaller_size="100KB"), ["small.bin", "medium.bin"]),
        (FilterConfig(larger_size=2**64 - 1), []),
        (FilterConfig(smaller_size=2**64 - 1), list(SIZES)),
    ],
)
def test_sizes(rows, config, kept):
    assert keys(apply_filters(rows(*[row(k, s) for k, s in SIZES.items()]), config)) == kept


def test_before_is_strict_and_after_inclusive(rows):
    df = rows(*[row(k, last_modified=DAY + dt.timedelta(days=n)) for n, k in enumerate(["old", "mid", "new"])])
    pivot = DAY + dt.timedelta(days=1)
    assert keys(apply_filters(df, FilterConfig(mtime_before=pivot))) == ["old"]
    assert keys(apply_filters(df, FilterConfig(mtime_after=pivot))) == ["mid", "new"]
    naive = FilterConfig(mtime_after=pivot.astimezone(UTC).replace(tzinfo=None))
    assert keys(apply_filters(df, naive)) == ["mid", "new"]


def test_storage_classes(rows):
    classes = {"std": None, "rrs": "REDUCED_REDUNDANCY", "ia": "STANDARD_IA", "oz": "ONEZONE_IA", "it": "INTELLIGENT_TIERING"}
    df = rows(*[row(k, storage_class=c) for k, c in classes.items()])
    assert keys(apply_filters(df, FilterConfig(storage_class=("STANDARD",)))) == ["std"]
    assert keys(apply_filters(df, FilterConfig(storage_class=("STANDARD_IA", "ONEZONE_IA")))) == ["ia", "oz"]
    for wrong in ("INVALID", "standard", "", "WARM", "S3_STANDARD"):
        with pytest.raises(ValueError):
            apply_filters(df, FilterConfig(storage_class=(wrong,)))


def test_all_filters_each_with_a_row_that_only_it_drops(rows):
    new, old = DAY, DAY - dt.timedelta(days=30)
    df = rows(
        row("target.csv", 5000, last_modified=new),
        row("target-old.csv", 5000, last_modified=old),
        row("wrong.txt", 5000, last_modified=new),
        row("skip-target.csv", 5000, last_modified=new),
        row("small.csv", 10, last_modified=new),
        row("class.csv", 5000, last_modified=new, storage_class="GLACIER"),
        row("big.csv", 50000, last_modified=new),
        row("late.csv", 5000, last_modified=new + dt.timedelta(days=9)),
    )
    config = FilterConfig(
        include_regex=r"\.csv$",
        exclude_regex="^skip",
        mtime_before=new + dt.timedelta(days=1),
        mtime_after=new - dt.timedelta(days=1),
        smaller_size=10000,
        larger_size=1000,
        storage_class=("STANDARD",),
    )
    assert keys(apply_filters(df, config)) == ["target.csv"]
    dropped = {r["filter"]: r["dropped"] for r in rejections(df, config).collect()}
    assert dropped == dict.fromkeys(config.predicates(), 1)


def test_prefixes_pass_every_filter(rows):
    df = rows(row("readme.csv"), row("logs/", entry_type="PREFIX"), row("a.txt"))
    config = FilterConfig(include_regex=r"\.csv$", larger_size=0, mtime_after=DAY, storage_class=("STANDARD",))
    assert keys(apply_filters(df, config)) == ["readme.csv", "logs/"]
    assert rejections(df, config).collect()[0]["dropped"] == 1


def test_markers_pass_size_and_class_but_not_name_and_date(rows):
    df = rows(
        row("big.bin", 5000, version_id="1"),
        row("big.bin", 7000, version_id="2"),
        row("small.bin", 100, version_id="3"),
        row("small.bin", **MARKER),
    )
    assert keys(apply_filters(df, FilterConfig(larger_size=1000))) == ["big.bin", "big.bin", "small.bin"]
    assert keys(apply_filters(df, FilterConfig(storage_class=("GLACIER",)))) == ["small.bin"]
    assert keys(apply_filters(df, FilterConfig(include_regex="^big"))) == ["big.bin", "big.bin"]
    assert keys(apply_filters(df, FilterConfig(mtime_before=DAY))) == []
    assert keys(hide_delete_markers(df)) == ["big.bin", "big.bin", "small.bin"]


def test_rejections_observed_while_listing(spark, rows):
    from pyspark.sql import Observation

    df = rows(row("a.csv", 10), row("b.txt", 10), row("c.csv", 1), row("d/", entry_type="PREFIX"))
    config = FilterConfig(include_regex=r"\.csv$", larger_size=5)
    seen = Observation("drops")
    marked = observe_rejections(df, config, seen)
    assert keys(marked) == ["a.csv", "d/"]
    assert seen.get == {"include_regex": 1, "larger_size": 1}


def test_conditions_reach_the_scan(spark, rows, tmp_path):
    path = str(tmp_path / "inventory")
    rows(row("data/a", 1), row("x", 2)).write.parquet(path)
    config = FilterConfig(
        include_regex="^data/", mtime_after=DAY, larger_size=1, storage_class=("STANDARD", "GLACIER")
    )
    plan = apply_filters(spark.read.parquet(path), config)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1]
    assert pushed.startswith("[Or(EqualTo(entry_type,PREFIX),")
    for part in ("StringStartsWith(key,data/)", "GreaterThanOrEqual(size,1)", "In(storage_class", "GreaterThanOrEqual(last_modified"):
        assert part in pushed, plan
