"""Directory counts by deltas against a full count."""

import random

import pytest
from conftest import row

from bucketscope.operators.hierarchy import discover_prefixes
from bucketscope.operators.prefix_table import PrefixTable


def made(n, seed):
    rng = random.Random(seed)
    return [
        row(f"{rng.choice('abc')}/{rng.randrange(3)}/{rng.choice(['', 'd/'])}k{seed}-{i}", rng.randrange(99), bucket=f"b{i % 2}",
            entry_type="DELETE_MARKER" if i % 9 == 0 else "OBJECT")
        for i in range(n)
    ]


def found(df):
    return sorted(map(tuple, df.select("bucket", "level", "prefix", "object_count", "total_size").collect()))


@pytest.mark.parametrize("prefix, depth", [("", 2), ("a/", 1), ("", 5)])
def test_deltas_give_what_a_full_count_gives(spark, rows, tmp_path, prefix, depth):
    table = PrefixTable(spark, str(tmp_path / "t"), prefix, depth)
    assert found(table.discover()) == []
    now = made(120, 1)
    table.apply("0", rows(*now))
    for step in (2, 3, 4):
        gone, came = now[: 40 * (step - 1)], made(30, step)
        table.apply(str(step), rows(*came), rows(*gone))
        table.apply(str(step), rows(*came), rows(*gone))  # applied again: the same
        now = now[len(gone) :] + came
        assert found(table.discover()) == found(discover_prefixes(rows(*now), prefix, depth))
        if step == 3:
            table.merge("merged")
            assert found(table.discover()) == found(discover_prefixes(rows(*now), prefix, depth))
    table.apply("end", removed=rows(*now))
    assert found(table.discover()) == []


def test_settings_and_identifiers(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    PrefixTable(spark, path, "a/", 2).apply("0", rows(*made(20, 1)))
    with pytest.raises(ValueError, match="depth 2"):
        PrefixTable(spark, path, "a/", 3)
    table = PrefixTable(spark, path, "a/", 2)
    for bad in ("", "a/b"):
        with pytest.raises(ValueError):
            table.apply(bad, rows(*made(2, 1)))
    with pytest.raises(ValueError, match="already"):
        table.merge("0")


def test_a_merge_that_was_cut_off_is_finished(spark, rows, tmp_path):
    table = PrefixTable(spark, str(tmp_path / "t"))
    table.apply("0", rows(*made(30, 1)))
    table.apply("1", rows(*made(30, 2)))
    wanted = found(table.discover())
    delete = table.system.delete
    table.rows().write.parquet(f"{table.path}/merging-all")
    spark.createDataFrame([("delta-0",), ("delta-1",)], "folder string").write.parquet(f"{table.path}/merged-all")
    delete(table._at("delta-0"), True)
    table.finish_merge("all")
    assert found(table.discover()) == wanted and table._folders() == ["delta-all"]
