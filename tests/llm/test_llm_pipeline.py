"""The corpus pipeline stage by stage, and the registered queries."""

import os
import sys
from collections import Counter

import duckdb
from test_llm_dedup import brute_exact, brute_near

import __spark_entry__ as entries
import corpus_pipeline
from bucketscope.llm import mixing, packing, quality
from bucketscope.llm.common import stored, table
from bucketscope.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.001"


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_every_stage_on_what_its_predecessor_kept(spark):
    docs = table(spark, SF_DIR, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    columns = docs.columns

    good = stored(stages["quality"](spark, docs, SF_DIR), "t")
    scores = quality.classify(docs, table(spark, SF_DIR, "labels")).where("predicted = 1")
    assert {d for d, _ in texts(good)} == {r["doc_id"] for r in scores.collect()}

    once = stored(stages["exact_dedup"](spark, good, SF_DIR), "t")
    assert sorted(d for d, _ in texts(once)) == sorted(r[0] for r in brute_exact(texts(good)) if r[3])

    apart = stored(stages["near_dedup"](spark, once, SF_DIR), "t")
    assert sorted(d for d, _ in texts(apart)) == sorted(d for d, _, c in brute_near(texts(once)) if d == c)

    mixed = stored(stages["mixing"](spark, apart, SF_DIR), "t")
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(apart).collect()}
    assert Counter(d for d, _ in texts(mixed)) == +Counter(taken)

    packed = stages["packing"](spark, mixed, SF_DIR).collect()
    pieces = packing.token_pieces(mixed, corpus_pipeline.tokenizer_file()).drop("ids").collect()
    assert Counter(tuple(r)[:5] for r in packed) == Counter(map(tuple, pieces))
    for df in (good, once, apart, mixed):
        assert df.columns == columns

    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter(tuple(r)[:5] for r in whole) == Counter(tuple(r)[:5] for r in packed)


def test_stages_of_an_empty_table(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), name)
        assert docs.count() == 0


def test_queries_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(QUERIES) | {"pipeline"} <= set(entries.queries()) and set(ORACLES) <= set(entries.oracle_sql())


def test_exact_dedup_agrees_with_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{SF_DIR}/documents.parquet'")
    wanted = connection.execute(ORACLES["op9_exact_dedup"]).fetchall()
    assert sorted(map(tuple, QUERIES["op9_exact_dedup"](spark, SF_DIR).collect())) == sorted(wanted)
