"""Exact and near duplicates against brute force."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from bucketscope.llm import exact_dedup, jaccard
from bucketscope.llm.components import components, hot_size, join_groups

SCHEMA = "doc_id long, text string, lang string, size long, kept boolean"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, "a b c d e f g h", None, 1, True),
    (2, "A b c d e f g h", "en", None, None),
    (3, None, None, None, None),
    (4, "", "en", 2, False),
    (5, " \t\n\x0b\x0c\r ", "en", 2, False),
    (6, "abcdefgh", "en", 2, False),
    (7, "a b c d e f  g h", "en", 2, False),
    (7, "a b c d e f  g h", "en", 2, False),
    (8, "one two", "en", 3, None),
    (9, "one two", "en", 3, None),
    (10, LONG, "en", 1, None),
    (11, LONG + " tail", "en", 1, None),
    (None, "a b c d e f g h", "en", 1, None),
    (12, "no-break space stays", "en", 1, None),
    (13, "no-breakspace stays", "en", 1, None),
]


def brute_exact(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0d]", "", text or "")
        keep = min(groups[norm])[3]
        out.append((doc_id, keep, len(groups[norm]), doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_exact_duplicates_agree_with_brute_force(spark, buckets):
    rng = random.Random(buckets)
    rows = [*ODD, *[(100 + i, rng.choice(["same text", "same  text", "sametext", f"own {i}"]), "x", 1, None) for i in range(300)]]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA), buckets=buckets).collect()
    assert sorted(map(tuple, found), key=str) == brute_exact(rows)


def test_rows_that_stay_are_one_of_each_text(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    stay = exact_dedup.drop_duplicates(docs)
    assert stay.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0d]", "", r["text"] or "") for r in stay.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0d]", "", r[1] or "") for r in ODD})


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(none).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_dedup.exact_duplicates(none).count() == exact_dedup.drop_duplicates(none).count() == 0
    assert jaccard.near_duplicates(none).count() == jaccard.one_of_each(none).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_near(rows):
    """Size and component of every row, by comparing all pairs of different sets."""
    sets = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None and shingles(text):
            sets.setdefault(shingles(text), []).append(doc_id)
    label = {s: min(ids) for s, ids in sets.items()}
    while True:
        links = [(a, b) for a, b in itertools.combinations(sets, 2) if label[a] != label[b] and 100 * len(a & b) >= 75 * len(a | b)]
        if not links:
            break
        for a, b in links:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {s: new if of == old else of for s, of in label.items()}
    return sorted(((d, len(shingles(t)), label[shingles(t)] if d is not None and shingles(t) else d) for d, t, *_ in rows), key=str)


def near_copies(rng):
    rows, at = [], 1000
    for family in range(12):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.randrange(4, 120))]
        for _ in range(rng.randrange(1, 14)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
            rows.append((at, " ".join(words) + rng.choice(["", " ", " more"]), "en", 1, None))
            at += 1
    passage = " ".join(f"shared{i}" for i in range(30))
    return rows + [(at + i, f"{passage} own{i} own{i + 1}", "en", 1, None) for i in range(40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_agree_with_brute_force(spark, seed):
    rows = [*ODD, *near_copies(random.Random(seed))]
    random.Random(seed).shuffle(rows)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=str) == brute_near(rows)


def test_one_of_each_keeps_a_document_per_component(spark):
    rows = [*ODD, *near_copies(random.Random(3))]
    docs = spark.createDataFrame(rows, SCHEMA)
    stay = jaccard.one_of_each(docs)
    assert stay.columns == docs.columns
    wanted = {d for d, _, c in brute_near(rows) if d == c}
    assert {r["doc_id"] for r in stay.collect()} == wanted


def test_bound_of_overlap_is_never_too_small():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        common, own, other = rng.integers(0, 300, 3)
        values = rng.integers(0, 1 << 63, common + own + other, dtype=np.uint64)
        one, two = np.unique(values[: common + own]), np.unique(np.concatenate([values[:common], values[common + own :]]))
        bound = jaccard.most_overlap(len(one), jaccard.parity_bits(one), len(two), jaccard.parity_bits(two))
        assert bound >= len(np.intersect1d(one, two))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(500, 501), (501, 500), (700, 700)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    wanted = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(300)} | {500: 500, 501: 500}
    assert {r["node"]: r["component"] for r in found.collect()} == wanted


def test_join_groups_serves_hot_and_small_groups(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 600, 0, id) as g")
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    assert hot_size(1000) == 64 and hot_size(10**8) == 10**4
    found = join_groups(rows, groups, ["g"], "n", 1000).collect()
    assert {(r["id"], r["least"]) for r in found} == {(i, 0 if i < 600 else i) for i in range(1000)}


def test_a_shorter_row_of_the_identifier_that_stays_goes(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "ab"), (2, "a  b"), (3, "x"), (3, "x")], "doc_id long, text string")
    found = sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect())
    assert found == [(1, 2, False), (1, 2, False), (2, 2, True), (3, 3, True), (3, 3, True)]
    docs = spark.createDataFrame([(1, "a b"), (1, "ab")], "doc_id long, text string")
    assert sorted(r["kept"] for r in exact_dedup.exact_duplicates(docs).collect()) == [False, True]
    assert [r["text"] for r in exact_dedup.drop_duplicates(docs).collect()] == ["a b"]


def test_overlaps_are_accumulated_over_blocks_of_columns():
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [np.zeros(0, np.uint64)]
    for _ in range(60):
        base = rng.integers(0, 1 << 64, rng.integers(1, 400), dtype=np.uint64)
        for share in (1.0, 0.95, 0.86, 0.8, 0.3):
            kept = base[rng.random(len(base)) < share]
            rows.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 64, rng.integers(0, 12), dtype=np.uint64)])))
    # entries of one block of columns only
    rows += [np.arange(40, dtype=np.uint64), np.arange(5, 45, dtype=np.uint64), np.array([(1 << 64) - 1], np.uint64)]
    left, right = map(np.array, zip(*itertools.combinations(range(1, len(rows)), 2)))
    found = jaccard.overlapping(left, right, rows)
    sets = [set(r.tolist()) for r in rows]
    wanted = [100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in zip(left, right)]
    assert found.tolist() == wanted and 60 < sum(wanted) < len(wanted)


def test_counters_are_summed_over_many_tasks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "SUMMED_TASKS", 3)
    rows = [(i, f"{'the ' * (i % 300)}word{i % 7} and more of text {i}", "en", 1, None) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(11)
    found = jaccard.corpus_counts(docs.select(F.col("text").cast("binary")))
    words = [jaccard.word_hashes(t.encode()) for _, t, *_ in rows]
    wanted = np.zeros(len(found), np.int64)
    for w in words:
        np.add.at(wanted, (w % jaccard.WORD_COUNTERS).astype(np.int64) + jaccard.SHINGLE_COUNTERS, 1)
        np.add.at(wanted, (np.unique(jaccard.shingle_hashes(w)) % jaccard.SHINGLE_COUNTERS).astype(np.int64), 1)
    assert (found == wanted).all()
    assert jaccard.corpus_counts(docs.where("false").select(F.col("text").cast("binary"))).sum() == 0


def test_columns_too_large_for_a_task_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "large_counters", lambda counts: counts > 6)
    rows = [*ODD, *near_copies(random.Random(4))]
    base = [f"hot{i}" for i in range(80)]
    rows += [(3000 + i, " ".join([*base[: i % 75], f"own{i}", *base[i % 75 + 1 :]]), "en", 1, None) for i in range(120)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, found), key=str) == brute_near(rows)


def test_coarse_bits_bound_the_overlap_of_long_sets(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    for n, m in ((900, 1100), (1800, 2300), (3000, 4000), (9000, 12000)):
        common = rng.integers(0, 1 << 64, n // 10, dtype=np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 64, size - n // 10, dtype=np.uint64)])) for size in (n, m)]
        one, two = (np.array(jaccard.coarse_bits(jaccard.parity_bits(s)), np.int64) for s in sets)
        while len(one) != len(two):
            one, two = (np.bitwise_xor(*np.split(b, 2)) if len(b) > min(len(one), len(two)) else b for b in (one, two))
        bound = (len(sets[0]) + len(sets[1]) - int(np.bitwise_count(one ^ two).sum())) // 2
        assert len(np.intersect1d(*sets)) <= bound and bound * 175 < 75 * (n + m)
        assert len(one) <= jaccard.MOST_COARSE_WORDS
    bits = jaccard.coarse_bits(jaccard.parity_bits(sets[0]))
    folded = spark.createDataFrame([(bits,)], "coarse array<long>").select(jaccard._folded(F.col("coarse"))).first()[0]
    assert folded == np.bitwise_xor(*np.split(np.array(bits, np.int64), 2)).tolist()
