"""Mixing, packing and sharding against brute force, exact round trips and exact sizes."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bucketscope.llm import mixing, packing, sharding
from bucketscope.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, source string, size long, shard int, taken long"


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "Z", "a" * 30, ""]
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))), sources[min(rng.randrange(12), 6)], 1, None, 2) for i in range(n)]
    odd = [(n, None, "b", None, None, None), (n + 1, "", "b", 1, 1, 1), (n + 2, " \t\n", None, 1, 1, 1), (n + 3, "x " * 3000, "a", 1, 1, 1)]
    return rows + odd + [(n + 4, "twice the same row", "b", 1, 1, 1)] * 2 + [(None, "no identifier", "b", 1, 1, 1)]


def brute_targets(words):
    order = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in words else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, fixed, budget = {}, set(), 1.5 * sum(words.values())
    while len(fixed) < len(order):
        level = (budget - sum(2 * words[s] for s in fixed)) / sum(weight[s] for s in order if s not in fixed)
        over = {s for s in order if s not in fixed and weight[s] * level >= 2 * words[s]}
        if not over:
            break
        fixed |= over
    for s in order:
        target[s] = 2.0 * words[s] if s in fixed else weight[s] * level
    return target


def test_mix_agrees_with_fair_queueing(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    keys = {tuple(r)[:2]: (r["u"], r["tie"]) for r in docs.select(
        "doc_id", "text", F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text"), F.lit(1 << 40)).alias("u"), F.xxhash64(F.lit("tie"), "doc_id", "text").alias("tie")
    ).collect()}
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))
    words = defaultdict(int)
    for _, text, source, *_ in rows:
        words[source] += size(text)
    target = brute_targets(words)
    queue = []
    for source in words:
        before = 0
        own = sorted((r for r in rows if r[2] == source), key=lambda r: (*keys[r[:2]], r[0] or 0))
        for r in own:
            n = size(r[1])
            for copy in (0, 1) if n else ():
                queue.append(((copy * words[source] + before + n) / target[source], source is None, source or "", *keys[r[:2]], copy, r[0], n))
            before += n
    total, taken = 0, Counter()
    for entry in sorted(queue, key=lambda e: e[:6]):
        total += entry[-1]
        if total > 1.5 * sum(words.values()):
            break
        taken[entry[6]] += entry[-1]
    found = mixing.mix(docs, keep=["source"]).collect()
    assert len(found) == len(rows)
    got = Counter()
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == words[r["source"]]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        got[r["doc_id"]] += r["taken"]
    assert +got == taken
    again = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in found)
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns
    assert Counter(r["doc_id"] for r in repeated.collect()) == +Counter({k: sum(r["copies"] for r in found if r["doc_id"] == k) for k in {r["doc_id"] for r in found}})


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None, 1, 1, 1), (2, " ", "a", 1, 1, 1)], SCHEMA)).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in blank} == {(0, 0.0, 0)}
    with pytest.raises(ValueError, match="taken"):
        mixing.mix(spark.createDataFrame([], SCHEMA), keep=["taken"])


def test_encoder_agrees_with_the_tokenizer():
    encode = packing.Encoder(tokenizer_file())
    rng = random.Random(2)
    parts = [" ", " ", "  ", "\n", "\t", "a", "bc", "Über", "don't", "'s", "12", ".", ",", "!!", "½", " ", "\x1c", "<|endoftext|>", "日本", "ǆ", "ɐ"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 16))) for _ in range(3000)]
    for text in texts:
        assert encode(text) == encode.ids(text), repr(text)


def test_encoder_agrees_with_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    fresh, encode = Tokenizer.from_file(tokenizer_file()), packing.Encoder(tokenizer_file())
    added = [t.content for t in fresh.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in added
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "a", "bc", "Über", "don't", "12", ".", "日本", "<|", "endoftext", *added]
    texts = [*added, "one two<|endoftext|> three", *("".join(rng.choices(parts, k=rng.randrange(0, 12))) for _ in range(2000))]
    for text in texts:
        ids = fresh.encode(text, add_special_tokens=False).ids
        assert encode(text) == np.array(ids, dtype="<u4").tobytes(), repr(text)


def test_texts_of_a_column_agree_with_the_tokenizer(monkeypatch):
    """In groups of any size, with words and blanks of every kind, nulls, empty texts and texts longer than a group."""
    rng = random.Random(6)
    parts = [" ", " ", " ", "  ", "\n", "\n", "\r\n", "\t", "a", "bc", "Word", "\u00dcber", "\u0153", "\u010a", "\u0120", "don't", "'s", "12", ".", ",", "...", "-", "\u00bd", "\u2028",
             "\x1c", "\x85", "<|endoftext|>", "\u65e5\u672c", "\u01c6", "\u0250", "e\u0301"]
    texts = [None, "", "\n", " ", "x" * 700, *("".join(rng.choices(parts, k=rng.randrange(0, 16))) for _ in range(4000)), None]
    encode = packing.Encoder(tokenizer_file())
    wanted = [encode.ids(text or "") for text in texts]
    for most in (1, 500, 8 << 20):
        monkeypatch.setattr(packing, "GROUP_BYTES", most)
        assert list(packing.Encoder(tokenizer_file()).texts(pa.array(texts))) == wanted
        assert list(packing.Encoder(tokenizer_file()).texts(pa.array(["cut off", *texts], pa.large_string()).slice(1))) == wanted
    assert list(encode.texts(pa.array([], pa.string()))) == []


def test_new_words_of_a_column_are_encoded_together(monkeypatch):
    """Words seen for the first time cost no call each, and are not kept: memory does not grow with them."""
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 10_000)
    encode, plain = packing.Encoder(tokenizer_file()), packing.Encoder(tokenizer_file())
    asked = []

    class Lines:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return plain.lines.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encode.lines, encode.model = Lines(), None
    letters = "abcdefgh\u00e4\u0153"
    words = ["".join(letters[int(c)] for c in str(n)) for n in range(30_000)]
    texts = ["the " + " ".join(words[n : n + 100]) + ".\nThe end, again" for n in range(0, len(words), 100)]
    assert list(encode.texts(pa.array(texts))) == [plain.ids(text) for text in texts]
    assert len(asked) == 4 and not encode.later and len(encode.first) < 5


def test_pieces_and_places(spark):
    rows = corpus(60) + [(900, "word " * 5000, "a", 1, 1, 1), (901, "tail " * 2047, "a", 1, 1, 1)]
    capacity = 256
    docs = spark.createDataFrame(rows, SCHEMA)
    pieces = packing.token_pieces(docs, tokenizer_file(), capacity).collect()
    encode = packing.Encoder(tokenizer_file())
    wanted = Counter()
    for doc_id, text, *_ in rows:
        ids = encode.ids(text or "") + bytes(4)
        n = len(ids) // 4
        cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])] += 1
            assert b - a <= capacity
    assert Counter(tuple(r)[:5] for r in pieces) == wanted
    packed = packing.pack_documents(docs, tokenizer_file(), capacity).collect()
    assert Counter(tuple(r)[:5] for r in packed) == wanted
    filled = defaultdict(list)
    for r in packed:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in filled.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(filled) <= 1.05 * sum(r["length"] for r in packed) / capacity + 1
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_file()).count() == 0


def fewest(items, capacity):
    """The least number of sequences, by trying everything."""
    best = len(items)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(items):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= items[at]}:
            rest = list(rooms)
            rest.remove(room)
            place(at + 1, [*rest, room - items[at]])
        place(at + 1, [*rooms, capacity - items[at]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


def test_fixed_sets_leave_the_optimum_in_reach():
    rng = random.Random(4)
    fixed_any = 0
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        items = [rng.randrange(1 if rng.random() < 0.3 else 3, capacity + 1) for _ in range(rng.randrange(1, 9))]
        histogram = packing.Histogram(Counter(items))
        fixed = packing.reduced(histogram, capacity)
        rest = [length for length, n in histogram.counts.items() for _ in range(n)]
        fixed_any += bool(fixed)
        assert sum(times for _, times in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)
        plan = packing.pack_lengths(Counter(items), capacity)
        assert sum((Counter({k: n * times for k, n in p}) for p, times in plan), Counter()) == Counter(items)
        assert all(sum(k * n for k, n in p) <= capacity for p, _ in plan)
    assert fixed_any > 100


def test_plan_of_a_large_histogram_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, 1 + rng.lognormal(6, 1, 300_000)).astype(int)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.pack_lengths(counts)
    assert sum(times for _, times in plan) <= 1.001 * lengths.sum() / 2048 + 1


def test_matrix_has_exact_sums():
    blocks = [b[2] for b in sharding.block_sizes(1003, 7, 50)]
    matrix = sharding.communication_matrix([500, 0, 3, 500], blocks, 1)
    assert matrix.sum(axis=1).tolist() == [500, 0, 3, 500] and matrix.sum(axis=0).tolist() == blocks and (matrix >= 0).all()
    large = sharding.communication_matrix([10**9, 2 * 10**9], [10**9] * 3, 1)
    assert large.sum(axis=1).tolist() == [10**9, 2 * 10**9] and large.sum(axis=0).tolist() == [10**9] * 3


def test_large_draws_have_the_right_moments(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_ROWS", 0)
    rng = np.random.default_rng(3)
    drawn = np.array([sharding.draw(rng, 300, 700, 100) for _ in range(4000)])
    assert abs(drawn.mean() - 30) < 0.4 and abs(drawn.var() - 100 * 0.3 * 0.7 * 900 / 999) < 1.5
    assert {sharding.draw(rng, 2, 0, 1), sharding.draw(rng, 0, 2, 1)} == {1, 0}
    assert [sharding.draw(rng, 5, 5, 10), sharding.draw(rng, 5, 5, 0)] == [5, 0]


@pytest.mark.parametrize("shards, block_rows", [(16, 1 << 16), (3, 20), (500, 10)])
def test_shards_have_exact_sizes_and_gapless_slots(spark, shards, block_rows):
    docs = spark.createDataFrame(corpus(300), SCHEMA).repartition(5)
    rows = docs.select(*sharding.digest_columns("doc_id", "text"))
    placed = sharding.shuffle_to_shards(rows, shards, block_rows=block_rows).collect()
    assert Counter(tuple(r)[:3] for r in placed) == Counter(map(tuple, rows.collect()))
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    empty = sharding.shuffle_to_shards(rows.limit(0), shards)
    assert empty.count() == 0 and empty.columns[-2:] == ["shard", "slot"]


def test_digest_of_a_text(spark):
    rows = spark.createDataFrame([(1, "né"), (2, None), (3, "")], "doc_id long, text string")
    found = rows.select(*sharding.digest_columns("doc_id", "text")).collect()
    assert [tuple(r) for r in found] == [(1, 4, zlib.crc32("né".encode())), (2, 1, 0), (3, 1, 0)]
    with pytest.raises(ValueError, match="shard"):
        sharding.shuffle_to_shards(rows.withColumn("SHARD", F.lit(1)))


def test_shuffle_is_uniform(spark):
    """Each input position lands in each quarter of the shuffled order about equally often."""
    rows = spark.range(0, 40, 1, 4)
    seen = np.zeros((40, 4))
    for seed in range(40):
        for r in sharding.shuffle_to_shards(rows, 4, seed).collect():
            seen[r["id"], r["shard"]] += 1
    assert (seen.sum(axis=1) == 40).all()
    assert ((seen - 10) ** 2 / 7.5).sum() < 40 * 3 + 6 * (2 * 40 * 3) ** 0.5


def test_equal_rows_are_spread_like_any_others(spark):
    """A third of all rows are one row: each shard gets its hypergeometric share, and runs of it are as short as chance has it."""
    n, same, shards = 6000, 2000, 16
    rows = spark.range(n, numPartitions=6).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"), F.lit(None).cast("string").alias("s"))
    placed = sharding.shuffle_to_shards(rows, shards, block_rows=100).collect()
    counts = Counter(r["shard"] for r in placed if r["v"] == -1)
    assert sum(counts.values()) == same and set(Counter(r["shard"] for r in placed).values()) == {n // shards}
    p, size = same / n, n // shards
    spread = (size * p * (1 - p) * (n - size) / (n - 1)) ** 0.5
    assert all(abs(counts[s] - size * p) < 5 * spread for s in range(shards))
    chi = sum((counts[s] - size * p) ** 2 for s in range(shards)) / spread**2
    assert chi < 15 + 6 * (2 * 15) ** 0.5
    # neighbouring slots hold the row together about as often as independent places would
    order = [r["v"] == -1 for r in sorted(placed, key=lambda r: (r["shard"], r["slot"]))]
    together = sum(a and b for a, b in zip(order, order[1:]))
    assert abs(together - n * p * p) < 6 * (n * p * p) ** 0.5


def test_written_shards_are_read_back_in_order(spark, tmp_path):
    rows = spark.range(100)
    path = str(tmp_path / "shards")
    sharding.write_shards(rows, path, 4)
    back = spark.read.parquet(path).collect()
    assert {r["id"] for r in back} == set(range(100)) and Counter(r["shard"] for r in back) == {s: 25 for s in range(4)}
    assert all(sorted(r["slot"] for r in group) == list(range(25)) for _, group in itertools.groupby(sorted(back, key=lambda r: r["shard"]), key=lambda r: r["shard"]))


def test_chunks_asked_for_again_outlive_a_full_memory(monkeypatch):
    """Words that recur are encoded once though others fill the memory time and again, which stays within its bytes."""
    monkeypatch.setattr(packing, "CACHE_BYTES", 100_000)
    encode, plain = packing.Encoder(tokenizer_file()), packing.Encoder(tokenizer_file())
    asked = []
    tokenize = encode.model.tokenize

    class Model:
        def tokenize(self, word):
            asked.append(word)
            return tokenize(word)

    encode.model = Model()
    letters = "abcdefghij"
    for n in range(3000):
        text = "the " + "".join(letters[int(c)] for c in str(n)) + "x the"
        assert encode(text) == plain.ids(text)
    assert asked.count("\u0120the") == 1 and len(asked) > 3000
    assert len(encode.later) + len(encode.later.older) < 100_000 // packing.ENTRY_BYTES
