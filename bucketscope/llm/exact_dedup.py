"""Exact duplicates by a content sort (operator 9), in DataFrame operations only.

Texts are equal when they are identical after deleting every ASCII blank. The rows are dealt to range buckets by
sampled splitters, each bucket is sorted (Spark spills it where needed) so that equal texts become neighbours, and each
row is compared in full with the one before it. The order ends in length and identifier, so one text with a third of
all rows is spread over many buckets; what the buckets say about their first and last runs is put together from one row
per bucket.

Cost: a sampling pass over the texts and one shuffle of the normalised texts; after it, only the texts of buckets whose
neighbour begins with the same digest are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketscope.llm.common import free_name, shuffle_partitions, stored

BLANKS = r"[\x20\x09-\x0D]+"
#: Characters of a text in its range key. The key only spreads the sort: rows are sorted and compared by whole texts.
KEY_CHARS = 48
#: Sampled rows per range bucket, which bounds what the splitters need on the driver.
SAMPLES_PER_BUCKET = 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _head() -> Column:
    """The part of the range key that equal texts have in common."""
    return F.concat(F.substring("norm", 1, KEY_CHARS), F.lit("\x00"), F.col("digest"), F.lit("\x00"))


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"), normalised(F.col(text_column)).alias("norm"), F.length(text).alias("chars")
    )
    # longest first, then smallest identifier (a null one last): the first row of a run is the one that stays
    rank = F.concat(F.lpad((F.lit(2**31) - F.col("chars")).cast("string"), 10, "0"), F.xxhash64("doc_id").cast("string"))
    hashed = rows.withColumn("digest", F.sha2("norm", 256))
    return hashed.withColumn("key", F.concat(_head(), rank))


def _splitters(rows: DataFrame, buckets: int) -> list[str]:
    """Keys that cut the rows into about equal ranges, from a sample of bounded size."""
    total = rows.count()
    if not total or buckets < 2:
        return []
    share = min(1.0, buckets * SAMPLES_PER_BUCKET / total)
    sample = sorted(r[0] for r in rows.select("key").sample(False, share, seed=9).collect())
    return sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []


def _bucket(key: Column, splitters: list[str]) -> Column:
    """The number of splitters not above the key, by a coarse and a fine look-up."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    heads = F.lit([b[0] for b in blocks]).cast("array<string>")
    block = F.size(F.filter(heads, lambda s: s <= key)) - 1
    inside = F.get(F.lit(blocks).cast("array<array<string>>"), block)
    return F.when(block < 0, 0).otherwise(block * step + F.size(F.filter(inside, lambda s: s <= key)))


def _sorted_runs(rows: DataFrame, splitters: list[str]) -> DataFrame:
    """One row per document with its bucket, its run there, and that run's size and first row.

    The first and last row of each bucket keep their text for the comparison across buckets.
    """
    placed = rows.withColumn("bucket", _bucket(F.col("key"), splitters)).drop("key")
    # ordered by the head of the range key, so that a group over several buckets ends one and begins the next
    order = [_head(), "norm", F.desc("chars"), F.col("doc_id").asc_nulls_last()]
    spread = Window.partitionBy("bucket").orderBy(*order)
    marked = placed.select(
        "bucket", "doc_id", "digest", "chars",
        F.when(F.lag("norm").over(spread) == F.col("norm"), 0).otherwise(1).alias("head"),
        F.when(F.lag("digest").over(spread).isNull(), F.col("norm")).alias("first_text"),
        F.when(F.lead("digest").over(spread).isNull(), F.col("norm")).alias("last_text"),
        F.row_number().over(spread).alias("place"),
    )
    along = Window.partitionBy("bucket").orderBy("place")
    runs = marked.withColumn("run", F.sum("head").over(along))
    run = Window.partitionBy("bucket", "run")
    best = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id")
    return runs.select(
        "bucket", "run", "doc_id", "digest", "chars", "first_text", "last_text",
        F.count(F.lit(1)).over(run).alias("run_size"), F.min(best).over(run).alias("best"),
    )


def _across_buckets(runs: DataFrame) -> DataFrame:
    """For each first and last run of a bucket, the size and best row of the whole group that it belongs to.

    One row per bucket, with digests, is put in order here, and nothing else: their number is that of the splitters. Where
    the digests of neighbours agree, their texts are brought together in a join, and only those equal in full become one
    group.
    """
    edges = runs.groupBy("bucket").agg(
        F.max("run").alias("runs"),
        F.max(F.when(F.col("first_text").isNotNull(), F.col("digest"))).alias("first_digest"),
        F.max(F.when(F.col("last_text").isNotNull(), F.col("digest"))).alias("last_digest"),
        F.max_by("run_size", "run").alias("last_size"),
        F.max_by("best", "run").alias("last_best"),
        F.min_by("run_size", "run").alias("first_size"),
        F.min_by("best", "run").alias("first_best"),
    )
    in_order = Window.orderBy("bucket")
    same = F.lag("last_digest").over(in_order) == F.col("first_digest")
    beside = edges.select("bucket", F.when(same, F.lag("bucket").over(in_order)).alias("before")).where("before is not null")
    first_texts = runs.where("first_text is not null").select("bucket", "first_text").hint("merge")
    last_texts = runs.where("last_text is not null").select(F.col("bucket").alias("before"), "last_text").hint("merge")
    equal = beside.join(first_texts, "bucket").join(last_texts, "before").where("first_text = last_text")
    equal = equal.select("bucket", F.lit(True).alias("joined"))
    joined = edges.drop("first_digest", "last_digest").join(equal, "bucket", "left").withColumn("joined", F.coalesce("joined", F.lit(False)))
    # a chain of equal runs begins in a bucket whose last run does not go back to the bucket before
    chain_start = F.when((F.col("runs") > 1) | ~F.col("joined"), F.col("bucket"))
    chains = joined.select(
        "*",
        F.last(chain_start, True).over(in_order).alias("last_chain"),
        F.last(chain_start, True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("previous_chain"),
    )
    first = chains.select(
        "bucket", F.lit(1).alias("run"), F.when(F.col("joined"), F.col("previous_chain")).alias("chain"),
        F.col("first_size").alias("size"), F.col("first_best").alias("best"),
    ).where("chain is not null")
    last = chains.where("runs > 1 or not joined").select(
        "bucket", F.col("runs").alias("run"), F.col("last_chain").alias("chain"),
        F.col("last_size").alias("size"), F.col("last_best").alias("best"),
    )
    members = first.unionByName(last)
    whole = members.groupBy("chain").agg(F.sum("size").alias("whole_size"), F.min("best").alias("whole_best"))
    return members.select("bucket", "run", "chain").join(whole, "chain").drop("chain")


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int | None = None
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the one with the most code points in its original text stays, then the smallest identifier (a null
    one last); another row of its identifier that is shorter does not. A null text counts as empty; all blank texts are one
    group. Rows that repeat identifier and length of the row that stays are kept too. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_column, text_column)
    buckets = buckets or 4 * shuffle_partitions(spark)
    runs = stored(_sorted_runs(rows, _splitters(rows, buckets)), "content-sort")
    # at most two rows per bucket, and the number of buckets is a parameter
    edges = F.broadcast(_across_buckets(runs))
    found = runs.drop("first_text", "last_text").join(edges, ["bucket", "run"], "left")
    best = F.coalesce("whole_best", "best")
    keep = best["doc_id"]
    stays = F.col("doc_id").eqNullSafe(keep) & (F.col("chars") == -best["chars"])
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("whole_size", "run_size").alias("group_size"),
        stays.alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with their own columns. Of rows repeated whole, one stays."""
    found = exact_duplicates(docs, id_column, text_column).where("kept").select("doc_id", "text_sha256").distinct()
    digest = free_name(docs.columns, "_digest")
    hashed = docs.withColumn(digest, F.sha2(normalised(F.col(text_column)), 256))
    same = hashed[id_column].eqNullSafe(found["doc_id"]) & (hashed[digest] == found["text_sha256"])
    staying = hashed.join(found.hint("merge"), same, "left_semi")
    # rows with the identifier that stays: the longest of them, as for other rows
    chars = free_name([*docs.columns, digest], "_chars")
    longest = Window.partitionBy(id_column, digest).orderBy(F.desc_nulls_last(chars))
    counted = staying.withColumn(chars, F.length(text_column))
    place = free_name([*docs.columns, digest, chars], "_place")
    first = counted.withColumn(place, F.row_number().over(longest)).where(F.col(place) == 1)
    return first.drop(digest, chars, place)
