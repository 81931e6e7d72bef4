import datetime as dt

import pyarrow as pa
import pytest
from conftest import DAY, row
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from bucketscope import fixtures
from bucketscope.catalog import audits
from bucketscope.operators.filters import FilterConfig, apply_filters
from bucketscope.operators.hierarchy import list_recursive
from bucketscope.operators.summary import summarize
from bucketscope.plans.listing import listing
from bucketscope.schema import LISTING_SCHEMA
from bucketscope.streaming import listing as streaming
from bucketscope.streaming.listing import (
    append_to,
    emit_prefixes,
    read_prefixes,
    read_stream,
    read_totals,
    refresh_totals,
    stream_listing,
    stream_prefixes,
    stream_summary,
)

CONFIG = FilterConfig(include_regex=r"\.csv$", larger_size=100, mtime_after=DAY)


def batch(rows, first, count):
    return rows(*[
        row(
            f"p{n % 3}/d{n % 5}/f{n}.{'csv' if n % 2 else 'txt'}", n,
            bucket=f"b{n % 2}", last_modified=DAY + dt.timedelta(hours=n - 120),
            entry_type="DELETE_MARKER" if n % 11 == 0 else "OBJECT",
        )
        for n in range(first, first + count)
    ])


@pytest.fixture
def inventory(rows, tmp_path):
    path = str(tmp_path / "inventory")
    batch(rows, 0, 150).repartition(5).write.parquet(path)
    return path


def test_stream_gives_what_batch_gives(spark, rows, inventory, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: append_to(stream_listing(read_stream(spark, inventory, LISTING_SCHEMA, 2), CONFIG), out, state).awaitTermination()
    run()
    expected = apply_filters(spark.read.parquet(inventory), CONFIG)
    assert expected.count() > 0
    assert spark.read.parquet(out).exceptAll(expected).count() == 0 and expected.exceptAll(spark.read.parquet(out)).count() == 0
    # new files only, from the checkpoint
    batch(rows, 150, 50).write.mode("append").parquet(inventory)
    run()
    expected = apply_filters(spark.read.parquet(inventory), CONFIG)
    assert expected.exceptAll(spark.read.parquet(out)).count() == 0
    assert spark.read.parquet(out).count() == expected.count()


def test_each_prefix_once_over_batches_and_restarts(spark, rows, inventory, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: append_to(stream_prefixes(read_stream(spark, inventory, LISTING_SCHEMA, 1), depth=2), out, state).awaitTermination()
    run()
    batch(rows, 150, 50).write.mode("append").parquet(inventory)
    run()
    folded = list_recursive(spark.read.parquet(inventory), max_depth=2).filter(F.col("entry_type") == "PREFIX")
    expected = sorted((r["bucket"], r["key"]) for r in folded.collect())
    assert sorted((r["bucket"], r["key"]) for r in spark.read.parquet(out).collect()) == expected


def test_running_summary(spark, rows, inventory, tmp_path):
    out = str(tmp_path / "totals")
    run = lambda state: refresh_totals(stream_summary(read_stream(spark, inventory, LISTING_SCHEMA, 2)), out, str(tmp_path / state)).awaitTermination()
    for first in (0, 150):
        if first:
            batch(rows, first, 50).write.mode("append").parquet(inventory)
        run("state")
        expected = summarize(spark.read.parquet(inventory), by=["bucket"])
        assert sorted(map(tuple, read_totals(spark, out).collect())) == sorted(map(tuple, expected.collect()))
    # an incomplete batch is not read, and another checkpoint is refused
    (tmp_path / "totals" / "batch-99").mkdir()
    assert read_totals(spark, out).count() == expected.count()
    with pytest.raises(ValueError, match="another checkpoint"):
        run("other")


def test_a_used_path_is_refused_with_another_checkpoint(spark, inventory, tmp_path):
    out = str(tmp_path / "out")
    listed = stream_listing(read_stream(spark, inventory, LISTING_SCHEMA))
    append_to(listed, out, str(tmp_path / "state")).awaitTermination()
    with pytest.raises(ValueError, match="another checkpoint"):
        append_to(listed, out, str(tmp_path / "new"))


def test_a_foreign_layout_stops_the_stream_at_its_start(spark, inventory, tmp_path):
    other = str(tmp_path / "foreign")
    spark.read.parquet(inventory).withColumnRenamed("key", "object_key").write.parquet(other)
    with pytest.raises(ValueError, match="no column key"):
        read_stream(spark, other, LISTING_SCHEMA)
    with pytest.raises(ValueError, match="no inventory"):
        read_stream(spark, str(tmp_path / "absent"), LISTING_SCHEMA)


def test_a_foreign_file_that_arrives_later_stops_the_stream(spark, rows, inventory, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    listed = read_stream(spark, inventory, LISTING_SCHEMA)
    run = lambda: append_to(stream_listing(listed, FilterConfig(larger_size=0), "p"), out, state).awaitTermination()
    run()
    before = spark.read.parquet(out).count()
    assert before == 150
    batch(rows, 150, 20).withColumnRenamed("key", "object_key").coalesce(1).write.mode("append").parquet(inventory)
    with pytest.raises(StreamingQueryException, match="without a value"):
        run()
    assert spark.read.parquet(out).count() == before
    with pytest.raises(ValueError, match="no column key"):
        read_stream(spark, inventory, LISTING_SCHEMA)


def test_a_failing_filter_stops_the_stream(spark, inventory, tmp_path):
    rows = read_stream(spark, inventory, LISTING_SCHEMA)
    broken = rows.withColumn("key", F.when(F.col("size") == 7, F.raise_error(F.lit("no match possible"))).otherwise(F.col("key")))
    query = append_to(stream_listing(broken, FilterConfig(include_regex="csv")), str(tmp_path / "out"), str(tmp_path / "state"))
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    # nothing of the failed batch was committed
    assert not (tmp_path / "out").exists() or spark.read.schema(LISTING_SCHEMA).parquet(str(tmp_path / "out")).count() == 0


def test_prefixes_once_without_stream_state(spark, rows, tmp_path, monkeypatch):
    """Over restarts, a batch that runs again, and merges: each directory once, no state, few folders."""
    monkeypatch.setattr(streaming, "MERGED", 3)
    source, out, state = (str(tmp_path / n) for n in ("inventory", "out", "state"))
    for first in range(0, 400, 40):
        batch(rows, first, 40).coalesce(2).write.mode("append").parquet(source)
        query = emit_prefixes(read_stream(spark, source, LISTING_SCHEMA, 1), out, state, depth=2)
        query.awaitTermination()
        assert all(not p.stateOperators for p in query.recentProgress)
        folded = list_recursive(spark.read.parquet(source), max_depth=2).filter(F.col("entry_type") == "PREFIX")
        found = read_prefixes(spark, out).collect()
        assert sorted((r["bucket"], r["key"]) for r in found) == sorted((r["bucket"], r["key"]) for r in folded.collect())
    assert len(list((tmp_path / "out").iterdir())) <= 7
    # the last batch again, as after a crash before it was committed
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    before = sorted(map(str, read_prefixes(spark, out).collect()))
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    emit_prefixes(read_stream(spark, source, LISTING_SCHEMA, 1), out, state, depth=2).awaitTermination()
    assert sorted(map(str, read_prefixes(spark, out).collect())) == before
    with pytest.raises(ValueError, match="another checkpoint"):
        emit_prefixes(read_stream(spark, source, LISTING_SCHEMA), out, str(tmp_path / "new"))
    with pytest.raises(ValueError, match="no prefixes"):
        read_prefixes(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("options", [
    {}, {"versions": True}, {"max_depth": 2, "versions": True, "hide_markers": True}, {"bucket": "b1", "recursive": True}, {"objects_only": True, "max_depth": 1, "versions": True},
])
def test_a_staged_stream_gives_what_a_listing_gives(spark, rows, inventory, tmp_path, options):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for more in (0, 150):
        if more:
            batch(rows, more, 50).write.mode("append").parquet(inventory)
        staged = stream_listing(read_stream(spark, inventory, LISTING_SCHEMA, 2), CONFIG, "p", whole=False, **options)
        append_to(staged, out, state).awaitTermination()
        expected = listing(spark.read.parquet(inventory), prefix="p", filters=CONFIG, sort=None, **options)
        assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, expected.collect()))
    with pytest.raises(ValueError, match="staged"):
        stream_listing(staged, CONFIG, bucket="b")


def test_repeats_of_a_directory_are_merged_before_the_shuffle(spark):
    repeated = pa.RecordBatch.from_pydict({"bucket": ["b"] * 3000 + [None], "at": ["a/", "b/", "a/"] * 1000 + ["a/"], "_salt": [1] * 3001})
    merged = list(streaming._merged(iter([repeated, repeated.slice(0, 0)])))
    rows = [tuple(r.values()) for b in merged for r in b.to_pylist()]
    assert sorted(rows, key=str) == sorted([("b", "a/", 1), ("b", "b/", 1), (None, "a/", 1)], key=str)


def test_an_inventory_of_many_files_takes_few_micro_batches(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "many")
    batch(rows, 0, 150).repartition(60).write.parquet(path)
    monkeypatch.setattr(fixtures, "inventory_path", lambda spark, sf_dir: path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    append_to(audits._stream(spark, "").select("key"), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 150
    assert len([f for f in (tmp_path / "state" / "commits").iterdir() if f.name.isdigit()]) <= audits.BATCHES
