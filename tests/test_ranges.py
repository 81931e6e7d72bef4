"""Ranges by splitters, and rows that look at the next one across their edges."""

import datetime as dt
import random

import pytest
from conftest import DAY, row
from pyspark.sql import functions as F

from bucketscope import session
from bucketscope.operators.hierarchy import write_inventory
from bucketscope.plans import ranges
from bucketscope.plans.ranges import instant_text, mark_last, range_of, splitters


@pytest.mark.parametrize("n, samples", [(1, 20), (2, 20), (13, 1), (40, 50)])
def test_ranges_are_in_order_and_whole(spark, monkeypatch, n, samples):
    monkeypatch.setattr(ranges, "SAMPLES_PER_RANGE", samples)
    df = spark.range(3000).select(F.format_string("k%05d", F.col("id") * 7 % 1000).alias("k"))
    cuts = splitters(df, "k", n)
    assert cuts == sorted(set(cuts)) and len(cuts) < n
    placed = df.select("k", range_of(F.col("k"), cuts).alias("r")).collect()
    assert all(r["r"] == sum(c <= r["k"] for c in cuts) for r in placed)
    assert {r["r"] for r in placed} == set(range(len(cuts) + 1))


@pytest.mark.parametrize("n, samples", [(1, 20), (7, 20), (60, 100)])
def test_last_rows_of_groups(spark, monkeypatch, n, samples):
    """Groups within a range, at its edges, and one that fills many ranges; names with separators in them."""
    monkeypatch.setattr(ranges, "SAMPLES_PER_RANGE", samples)
    rng = random.Random(n)
    keys = ["a", "a\x00", "a\x00\x01", "a\x00\x00", "", "b", "hot", "é", "hot/"]
    rows = [(rng.choice("xy"), rng.choice(keys), i) for i in range(600)] + [("x", "hot", 10_000 + i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k string, n int").repartition(4)
    found = mark_last(df, ["g", "k"], [F.format_string("%06d", "n")], "last", n)
    assert found.columns == ["g", "k", "n", "last"] and found.count() == len(rows)
    newest = {}
    for g, k, i in rows:
        newest[g, k] = max(newest.get((g, k), -1), i)
    assert {(r["g"], r["k"]): r["n"] for r in found.where("last").collect()} == newest
    assert found.where("last").count() == len(newest)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    # beside the one that the input has
    assert sum("Exchange" in line and "RoundRobin" not in line for line in plan) == 1 and not any("Join" in line for line in plan)


def test_a_range_holds_no_more_rows_when_the_table_grows(spark, monkeypatch):
    """Ranges by rows, whatever the number of shuffle partitions; no text of the order is shuffled, and no window holds a range."""
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    df = spark.range(4000).select((F.col("id") % 40).cast("string").alias("k"), F.col("id").alias("n"))
    found = mark_last(df, ["k"], [F.format_string("%06d", "n")], "last")
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 400
    assert sorted(r["n"] for r in found.where("last").collect()) == list(range(3960, 4000))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    assert "_address" not in plan[at + 1].split("AS _range")[1] and any("Window" in line and "_group" in line for line in plan[:at])


def test_instants_as_text_are_in_order(spark):
    moments = [None, dt.datetime(1, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(1970, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 1), dt.datetime(9999, 12, 31)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "i int, t timestamp").select("i", instant_text(F.col("t")).alias("s"))
    texts = [r["s"] for r in df.orderBy("i").collect()]
    assert texts == sorted(texts) and len(set(texts)) == len(texts)


def test_an_inventory_is_stored_with_its_latest_versions(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    listed = rows(*[
        row(f"k{i % 7}", i, bucket=f"b{i % 2}", version_id=f"v{i:03d}", last_modified=DAY + dt.timedelta(hours=i // 20)) for i in range(200)
    ])
    write_inventory(listed, path, 5, mark_latest=True)
    back = spark.read.parquet(path)
    newest = listed.groupBy("bucket", "key").agg(F.max(F.struct("last_modified", "version_id")).alias("at"))
    expected = {(r["bucket"], r["key"], r["at"]["version_id"]) for r in newest.collect()}
    assert {(r["bucket"], r["key"], r["version_id"]) for r in back.where("is_latest").collect()} == expected
    assert back.count() == 200 and back.where("is_latest is null").count() == 0
