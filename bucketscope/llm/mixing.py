"""Mixing sources to target weights by weighted fair queueing (operator 10), in DataFrame operations only.

Within its source, each document has a place in a shuffled order. A copy of a document finishes at the virtual time
(words of its source up to and with it) / (target of its source), so that in one unit of virtual time every source
serves its target. All copies are then sorted by virtual finish time, over ranges of time that hold about equally many
words by construction, and the order is cut where the total budget is reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketscope.llm.common import free_name, running_total, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Pieces of each source's shuffled order, by range of a uniform hash.
CHUNKS = 1024
#: Ranges of virtual time per unit.
RANGES = 4096
#: Doublings of virtual time, and ranges of each, for copies that finish after time 2.
LATE = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most_passes: int) -> DataFrame:
    """Per source, ``none, source, source_size, target`` from rows with ``none, source, size``.

    Sources in code point order, a null one last, take the weights in turn, and share ``share`` times all words by
    weight. A target stops at ``most_passes`` times its source's words; what it gives up is shared again among the
    others, round by round, until no target is above its limit. Each round is one sum over the sources.
    """
    by_source = sizes.groupBy("none", "source").agg(F.sum("size").cast("bigint").alias("source_size"))
    # numbered in sorted partitions, so that the sources need not meet in one task
    sorted_rows = stored(
        by_source.orderBy("none", "source").withColumn("_slot", F.monotonically_increasing_id()), "sources"
    )
    part = F.shiftright("_slot", 33)
    counts = sorted_rows.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per sorted partition
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.col("offset") + F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = sorted_rows.join(F.broadcast(offsets), part == F.col("part"))
    weight = F.get(F.lit([float(w) for w in weights]), (place % len(weights)).cast("int"))
    limit = F.col("source_size") * float(most_passes)
    sources = stored(
        ranked.select("none", "source", "source_size", weight.alias("weight"), limit.alias("limit")), "weights"
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level, full = float(share) * total, 0.0, -1
    while True:
        at_limit = F.col("weight") * level >= F.col("limit")
        fixed, open_weight, now_full = sources.agg(
            F.coalesce(F.sum(F.when(at_limit, F.col("limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(at_limit, 1)),
        ).first()
        if now_full == full or not open_weight:
            break
        full, level = now_full, (budget - fixed) / open_weight
    target = F.least(F.col("limit"), F.col("weight") * level)
    return sources.select("none", "source", "source_size", target.alias("target"))


def _time_range(finish: Column) -> Column:
    late = 2 * RANGES + F.least(F.floor(F.log2(finish / 2) * LATE), F.lit(64 * LATE))
    return F.when(finish < 2, F.floor(finish * RANGES)).otherwise(late).cast("bigint")


def _copies(queued: DataFrame, most_passes: int) -> DataFrame:
    passes = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most_passes - 1))))
    finish = (F.col("copy") * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target")
    return passes.where("size > 0").withColumn("finish", finish).withColumn("range", _time_range(F.col("finish")))


ORDER = ["finish", "none", "source", "u", "tie", "copy"]


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most_passes: int = 2,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies`` and the columns in ``keep``.

    ``size`` counts words; ``copies`` is how often the mix takes the document (0 to ``most_passes``), ``taken`` the
    words of these copies. Documents are taken whole, so a source may miss its target by one document.

    A null text has 0 words; documents without words are never taken (``taken`` 0, and so ``copies`` 0). A null source
    is a source of its own. The shuffled order follows a hash of identifier and text, so reruns agree; rows repeated
    whole are told apart by nothing and may be taken differently often. Kept columns whose names clash with the result's
    are refused. An empty table gives no rows.
    """
    made = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    if clash := {c.lower() for c in keep} & {*made}:
        raise ValueError(f"kept columns have names of the result: {sorted(clash)}")
    kept = F.struct(*keep) if keep else F.lit(None).cast("struct<x:int>")
    u = F.pmod(F.xxhash64(F.lit("mix"), id_column, text_column), F.lit(1 << 40))
    sizes = stored(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).isNull().alias("none"),
            F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
            word_count(F.col(text_column)).alias("size"),
            u.alias("u"),
            F.xxhash64(F.lit("tie"), id_column, text_column).alias("tie"),
            kept.alias("kept"),
        ).withColumn("chunk", F.shiftright("u", 30)),
        "sizes",
    )
    targets = source_targets(sizes, weights, share, most_passes)
    # the chunks' offsets carry the source's figures, so no join meets a whole source at once
    placed = running_total(sizes, ["none", "source"], "chunk", ["u", "tie", "doc_id"], F.col("size"), "before")
    chunks = sizes.select("none", "source", "chunk").distinct()
    figures = chunks.join(targets.hint("merge"), ["none", "source"])
    queued = stored(placed.join(figures.hint("merge"), ["none", "source", "chunk"]), "queued")
    budget = float(share) * (queued.agg(F.sum("size")).first()[0] or 0)
    last = _cut(_copies(queued, most_passes), budget)
    if last is None:
        copies = F.lit(0)
    else:
        end = F.struct(*[F.lit(last[c]).alias(c) for c in ORDER])
        taken = [
            F.when((F.col("size") > 0) & (F.struct(*[_at(copy)[c].alias(c) for c in ORDER]) <= end), 1).otherwise(0)
            for copy in range(most_passes)
        ]
        copies = sum(taken, F.lit(0))
    found = queued.withColumn("copies", copies)
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
        *[F.col("kept")[c].alias(c) for c in keep],
    )


def _at(copy: int) -> dict[str, Column]:
    finish = (F.lit(copy) * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target")
    return {c: F.col(c) for c in ORDER} | {"finish": finish, "copy": F.lit(copy)}


def _cut(copies: DataFrame, budget: float) -> dict | None:
    """The last copy in the order of virtual finish times up to which all words together stay within the budget."""
    copies = copies.select("range", "size", *ORDER)
    # ranges of time have a fixed number, so their totals are few
    per_range = copies.groupBy("range").agg(F.sum("size").alias("words"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = copies.withColumn("end", F.sum("size").over(within)).join(F.broadcast(offsets), "range")
    last = placed.where(F.col("start") + F.col("end") <= budget).agg(F.max(F.struct(*ORDER)).alias("last")).first()[0]
    return last.asDict() if last is not None else None


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns.

    The mix is made of narrow rows; the documents are joined to it once, by identifier and a hash of the whole row.
    Rows repeated whole share their copies.
    """
    row_hash, times = free_name(docs.columns, "_hash"), free_name(docs.columns, "_times")
    hashed = docs.withColumn(row_hash, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    mixed = mix(hashed, id_column=id_column, keep=[row_hash], **options).where("copies > 0")
    copies = mixed.groupBy("doc_id", row_hash).agg(F.sum("copies").cast("int").alias(times))
    same = hashed[id_column].eqNullSafe(copies["doc_id"]) & (hashed[row_hash] == copies[row_hash])
    found = hashed.join(copies.select("doc_id", row_hash, times).hint("merge"), same)
    columns = [hashed[f"`{c}`"] for c in docs.columns]
    once = found.select(*columns, hashed[row_hash].alias(row_hash), times).dropDuplicates([id_column, row_hash])
    repeated = once.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
