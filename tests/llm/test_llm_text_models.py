"""Classifier, language identification, license scans and pseudonyms."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketscope.llm import jaccard, language, licenses, pseudonyms, quality
from bucketscope.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, n_words int, label string"
LONG = "palabra larga " * 40_000
ODD = [
    (1, None, None, None, None, None),
    (2, "", "en", 1.0, 1, "x"),
    (3, " \n\t ", "en", 1.0, 1, "x"),
    (4, "12345 !!! ???", "en", 1.0, 1, "x"),
    (5, LONG, "es", 1.0, 1, "x"),
    (6, "x" * 200_000, "en", 1.0, 1, "x"),
    (7, "the same row", "en", 1.0, 1, "x"),
    (7, "the same row", "en", 1.0, 1, "x"),
    (None, "no identifier", None, 1.0, 1, "x"),
    (8, "Ünïcödé ÉTÉ  \x00 日本語", "fr", 1.0, 1, "x"),
]


def fold(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    found = QUERIES["op4_quality"](spark, SF_DIR).collect()
    assert len(found) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(r["held_out"] == fold(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(p == 1 for y, p in held if y == 1)


def test_quality_learns_nothing_from_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(150).cache()
    labels = spark.createDataFrame([(r[0], 1 + i % 2 - 1) for i, r in enumerate(docs.select("doc_id").collect())], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.fit(docs, labels), quality.fit(docs, turned)
    assert np.array_equal(one, two) and one.any()
    docs.unpersist()


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    found = quality.classify(docs, none).collect()
    assert len(found) == len(ODD) and {r["score"] for r in found} == {0.5} and {r["predicted"] for r in found} == {1}
    some = spark.createDataFrame([(5, 1, "x"), (6, 0, "x"), (6, None, "x"), (None, 1, "x"), (99, 1, "x"), (2, 7, "x"), (5, 1, "y")], "doc_id long, quality int, text string")
    found = {(r["doc_id"], r["score"]) for r in quality.classify(docs, some).collect()}
    assert all(0 <= s <= 1 for _, s in found) and len({s for d, s in found if d in (1, 2, 3)}) == 1
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert quality.classify(docs.limit(0), none).count() == 0


def test_a_word_is_scored_by_the_sum_of_its_features():
    rng = np.random.default_rng(1)
    model = rng.normal(size=quality.BUCKETS + 1)
    score = quality.Scorer(model)
    for text in ["one two two Ünï", "a " * 500, "", None, "x" * 5000]:
        buckets, shares = quality.features(text)
        z = float(model[buckets] @ shares) + model[-1]
        assert score(text) == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_language_of_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").collect()}
    found = QUERIES["op6_language"](spark, SF_DIR).collect()
    assert len(found) == len(lang) and all(r["held_out"] == fold(r["doc_id"]) for r in found)
    held = [(lang[r["doc_id"]], r["lang_pred"]) for r in found if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for word in words:
        for n in language.GRAM_SIZES:
            marked = word if n == 1 else f" {word} "
            out.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return out


def test_grams_are_those_of_each_word():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abÉß 1.\n日", k=rng.randrange(0, 30))) for _ in range(300)] + ["", "a", "a" * 1000]
    buckets, owner = language._grams(texts)
    names: dict[str, int] = {}
    for i, text in enumerate(texts):
        own = Counter(buckets[owner == i].tolist())
        wanted = brute_grams(text)
        assert sum(own.values()) == sum(wanted.values())
        if len(wanted) == 1:
            names.update(zip(wanted, own))
    alone = language._grams([texts[7]])[0]
    assert sorted(alone.tolist()) == sorted(buckets[owner == 7].tolist())


def test_naive_bayes_agrees_with_brute_force(spark):
    rows = [(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, "the bird", "en"), (4, "ein vogel", None), (5, None, "fr")]
    training = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = language.fit(training)
    assert langs == ["de", "en"]
    texts = ["the hund", "katze", "and", "x", None, "", "77"]
    found, scores = language.predict_texts(texts, langs, matrix)
    counts = {g: Counter(language._grams([t for _, t, of in rows if of == g])[0].tolist()) for g in langs}
    docs = Counter(g for _, t, g in rows if g and t)
    for text, lang, score in zip(texts, found, scores):
        if not text or not any(map(str.isalpha, text)):
            assert (lang, score) == ("und", 0.0)
            continue
        logs = {}
        for g in langs:
            total = sum(counts[g].values()) + 0.5 * language.BUCKETS
            logs[g] = math.log((docs[g] + 0.5) / (sum(docs.values()) + 1)) + sum(math.log((counts[g][b] + 0.5) / total) for b in language._grams([text])[0].tolist())
        best = max(langs, key=logs.__getitem__)
        share = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert lang == best and score == pytest.approx(share)


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, docs).collect()}
    assert [found[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and found[5] == "es"
    assert {r["lang_pred"] for r in language.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert language.identify(docs.limit(0), docs).count() == 0


TEMPLATES = [("short", "this work is licensed under the old license"), ("long", " ".join(f"term{i}" for i in range(70))), ("short", "all rights are kept by us")]


def brute_blocks(text, templates, threshold):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = set()
    for t, (_, template) in enumerate(templates):
        wanted = template.split()
        run = next((c for c in licenses.CLASSES if c >= len(wanted)), len(wanted))
        last = max(0, -(-len(words) // run) - 2)
        for block in range(last + 1 if words else 0):
            own = words[block * run : block * run + 2 * run]
            share = len(set(own) & set(wanted)) / len(set(wanted))
            if share >= threshold - 1e-12:
                found.add((t, block * run, len(own), round(share, 9)))
    return words, found


def test_blocks_that_meet_a_template_agree_with_brute_force(spark):
    rng = random.Random(6)
    rows = [(r[0] or -1, r[1]) for r in ODD]
    for i in range(150):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            passage = [w if rng.random() > 0.15 else "other" for w in rng.choice(TEMPLATES)[1].split()]
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = [w.upper() if rng.random() < 0.3 else w for w in passage]
        rows.append((100 + i, rng.choice([" ", ", ", "\n"]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.matching_blocks(docs, TEMPLATES).collect()
    got = {(r["doc_id"], r["template"], r["first_word"], r["n_words"], round(r["containment"], 9)) for r in found}
    wanted = {(d, *m) for d, text in rows for m in brute_blocks(text, TEMPLATES, licenses.THRESHOLD)[1]}
    assert got == wanted and len(wanted) > 50
    scanned = {r["doc_id"]: r for r in licenses.scan(docs, TEMPLATES).collect()}
    for doc_id, text in rows:
        words, blocks = brute_blocks(text, TEMPLATES, licenses.THRESHOLD)
        if [d for d, _ in rows].count(doc_id) == 1:
            assert scanned[doc_id]["n_words"] == len(words)
            assert scanned[doc_id]["labels"] == ",".join(sorted({TEMPLATES[b[0]][0] for b in blocks}))


def test_phrases_are_found_word_by_word(spark):
    rows = [
        (1, "Released UNDER the MIT-License, under\nthe mit license. under the mit licenses"),
        (2, "Apache License, Version 2.0 (cc BY nc) x"),
        (3, "under the the mit license apache license version two"),
        (4, "cc by nc cc by nc"),
        (5, None),
        (6, "under the mit licenseé"),
    ]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    key = lambda r: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"])
    assert key(found[1]) == (2, 1, 5, "mit", 1.0) and key(found[2]) == (2, 0, 5, "apache-2,cc-by-nc", 1.0)
    assert key(found[3]) == key(found[6]) == key(found[5]) == (0, None, None, "", 0.0)
    assert key(found[4]) == (2, 0, 3, "cc-by-nc", 1.0) and found[5]["n_words"] == 0
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="no words"):
        licenses.Index([("x", "...")], {}, 0.8)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def pseudonymised(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], r["n_replaced"]) for r in pseudonyms.pseudonymise(rows, "secret").orderBy("doc_id").collect()]


def test_pseudonyms_keep_formats_and_links(spark):
    card, again, mail, address, day, ssn, phone = pseudonymised(
        spark, "pay 4111 1111 1111 1111 now", "x4111 1111 1111 1111", "ask Ann.72@mail3.example.com.", "at 169.122.221.182,",
        "born 2024-02-29, 31.12.1999", "no 123-45-6789", "call +1 (017) 555-7713!",
    )
    number = re.fullmatch(r"pay (\d{4} \d{4} \d{4} \d{4}) now", card[0])[1]
    assert luhn(number.replace(" ", "")) and number != "4111 1111 1111 1111" and card[1] == 1
    assert again[0] == "x" + number
    assert re.fullmatch(r"ask [A-Z][a-z]{2}\.\d\d@mail3\.example\.com\.", mail[0]) and "Ann.72" not in mail[0]
    octets = re.fullmatch(r"at (\d+)\.(\d+)\.(\d+)\.(\d+),", address[0]).groups()
    assert all(int(o) < 256 for o in octets) and address[0] != "at 169.122.221.182,"
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d, \d\d\.\d\d\.\d{4}", day[0]) and day[1] == 2 and "2024-02-29" not in day[0]
    assert re.fullmatch(r"no 123-\d\d-\d{4}", ssn[0]) and ssn[0] != "no 123-45-6789"
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}!", phone[0]) and "555-7713" not in phone[0]


def test_what_is_not_valid_stays(spark):
    texts = ["4111111111111112", "300.1.1.1", "2023-02-29", "000-12-1234", "plain 12345 text @ home", "ab", "", None, "9" * 100_000]
    assert pseudonymised(spark, *texts) == [(t, 0) for t in texts]
    assert pseudonymised(spark, "ab 10.1.2.3 \x02c")[0][0].startswith("ab ")
    with pytest.raises(ValueError, match="TEXT"):
        pseudonyms.pseudonymise(spark.createDataFrame(ODD, SCHEMA), "k", count_column="TEXT")


def test_numbers_next_to_other_digits(spark):
    card, one = "4111 1111 1111 1111", "4111111111111111"
    (changed, _), (changed_one, _), (phone, n) = pseudonymised(spark, card, one, "555 123 4567")
    assert changed != card and changed_one != one
    assert n == 1 and phone != "555 123 4567" and re.fullmatch(r"\d{3} \d{3} \d{4}", phone)
    around = ["{} 123", "{} 12/27", "room 12 {}", "id 1234 {}", "x {} 10.300.2.3", "+1 {}", "7 {} 9"]
    found = pseudonymised(spark, *[a.format(c) for a in around for c in (card, one)])
    assert found == [(a.format(c), 1) for a in around for c in (changed, changed_one)]
    both, on_day = pseudonymised(spark, f"{card} {card} 555 123 4567", f"{card} 2023-12-25")
    assert both == (f"{changed} {changed} {phone}", 3)
    assert on_day[1] == 2 and on_day[0].startswith(changed + " ") and "2023-12-25" not in on_day[0]


def test_slash_dates_with_the_day_first(spark):
    days = [f"{d}/{m:02d}/{y}" for d in range(13, 29) for m in range(1, 13) for y in (1950, 2023)]
    found = pseudonymised(spark, *days)
    assert {n for _, n in found} == {1} and len({t for t, _ in found}) == len(days)
    assert all(int(t[:2]) > 12 and re.fullmatch(r"\d{2}/\d{2}/\d{4}", t) for t, _ in found)


def test_pseudonyms_are_permutations(spark):
    numbers = spark.range(pseudonyms.DAYS[0] * pseudonyms.DAYS[1])
    days = pseudonyms.permuted_number(F.col("id"), pseudonyms.DAYS, "k", "date")
    assert numbers.select(days.alias("d")).agg(F.countDistinct("d"), F.min("d"), F.max("d")).first()[:] == (73080, 0, 73079)
    texts = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("t"))
    changed = texts.select(pseudonyms.permuted_text(F.col("t"), "k", "x").alias("p"))
    assert changed.distinct().count() == 10_000 and changed.where("p rlike '^[0-9]{4}$'").count() == 10_000


def test_pseudonyms_of_odd_rows_keep_columns(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("_pieces", F.lit(1))
    found = pseudonyms.pseudonymise(docs, "k")
    assert found.columns == [*docs.columns, "n_replaced"]
    assert Counter(tuple(r)[:-1] for r in found.collect()) == Counter(map(tuple, docs.collect()))
    assert pseudonyms.pseudonymise(docs.limit(0), "k").count() == 0


def test_memory_is_bounded_by_bytes(spark):
    """Texts without blanks, which are one word each, leave nothing behind, and a very long one is worked on in slices."""
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 20_000))) for _ in range(60)]
    scorer = quality.Scorer(np.zeros(quality.BUCKETS + 1))
    hashes = jaccard._WordHashes()
    tracemalloc.start()
    for text in texts:
        scorer(text)
        hashes[text.encode()]
    held = tracemalloc.get_traced_memory()[0]
    assert len(hashes) == 0 and held < 1 << 20 and all(isinstance(k, bytes) and len(k) == 16 for k in scorer.rows)
    long = "wort " * 1_000_000
    tracemalloc.reset_peak()
    langs, matrix = ["a", "b"], np.log(np.full((2, language.BUCKETS + 1), 0.1))
    assert language.predict_texts([long], langs, matrix)[0] == ["a"]
    assert tracemalloc.get_traced_memory()[1] < 60 * len(long)
    tracemalloc.stop()


@pytest.mark.parametrize("piece", [3, 50, 1 << 16])
def test_long_words_have_the_buckets_of_short_ones(monkeypatch, piece):
    words = ["x", "word", "änderung", "w" * 200 + "é" + "z" * 90]
    wanted = [sorted(quality.word_buckets(w)) for w in words]
    text = " ".join(words + ["word", "word"] + words[-1:] * 2)
    before, score = quality.features(text), quality.Scorer(np.arange(quality.BUCKETS + 1) / 1e5)(text)
    monkeypatch.setattr(quality, "PIECE", piece)
    monkeypatch.setattr(quality, "LONG_WORD", 5)
    assert [sorted(b for part in quality.pieces(w) for b in part) for w in words] == wanted
    after = quality.features(text)
    assert (before[0] == after[0]).all() and np.allclose(before[1], after[1])
    assert quality.Scorer(np.arange(quality.BUCKETS + 1) / 1e5)(text) == pytest.approx(score)


def test_training_rows_are_bounded(spark):
    """An identifier with very many rows, and labels that repeat, bring no more rows to the training task than the bound."""
    docs = spark.createDataFrame([(i, f"good text {i}") for i in range(40)] + [(2, f"many rows {i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 5, "doc_id long, quality int")
    out = {r["doc_id"] for r in docs.where(quality.held_out(F.col("doc_id"))).select("doc_id").distinct().collect()}
    assert 2 not in out
    found = quality.training_features(docs, labels, training_documents=50)
    assert found.count() == 100
    few = quality.training_features(docs.where("text like 'good%'"), labels, training_documents=50)
    assert few.count() == 40 - len(out) == few.select("_id").distinct().count()


def test_pseudonyms_of_social_security_numbers_are_valid_and_distinct(spark):
    rng = random.Random(3)
    given = sorted({f"{rng.choice(['001', '123', '899'])}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(3000)})
    df = spark.createDataFrame([(i, f"no {v}.") for i, v in enumerate(given)], "doc_id long, text string")
    found = [r["text"][3:-1] for r in pseudonyms.pseudonymise(df, "k").orderBy("doc_id").collect()]
    assert all(re.fullmatch(r"\d{3}-(?!00)\d{2}-(?!0000)\d{4}", v) for v in found)
    assert len(set(found)) == len(given) and all(a[:4] == b[:4] for a, b in zip(given, found))
    assert sum(a != b for a, b in zip(given, found)) > 0.99 * len(given)
    odd = ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "doc_id long, text string")
    assert [r["text"] for r in pseudonyms.pseudonymise(df, "k").orderBy("doc_id").collect()] == odd


def test_pseudonyms_of_short_dates_ten_digits_and_accounts(spark):
    import datetime

    def iban_right(text):
        plain = text.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1

    ibans = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "NL91ABNA0417164300"]
    found = pseudonymised(spark, *[f"({i})" for i in ibans])
    for (text, n), iban in zip(found, ibans):
        new = text[1:-1]
        assert n == 1 and new != iban and new[:2] == iban[:2] and iban_right(new)
        assert [c.isdigit() for c in new[4:]] == [c.isdigit() for c in iban[4:]] and len(new) == len(iban)
    wrong = ["DE88370400440532013000", "AB12", "DE8937040044053201300012345678901234567"]
    assert [n for _, n in pseudonymised(spark, wrong[0], wrong[1])] == [0, 0]

    start = datetime.date(1985, 1, 1)
    for form, split in ((lambda d: f"{d.month}/{d.day}/{d.year}", "/"), (lambda d: f"{d.day}.{d.month}.{d.year}", ".")):
        days = [start + datetime.timedelta(days=i) for i in range(250)]
        texts = [form(d) for d in days if d.day < 10 or d.month < 10]
        news = pseudonymised(spark, *texts)
        assert all(n == 1 for _, n in news) and len({t for t, _ in news}) == len(texts)
        for new, _ in news:
            one, two, year = map(int, new.split(split))
            datetime.date(year, *((one, two) if split == "/" else (two, one)))
            assert not new.startswith("0") and f"{split}0" not in new and min(one, two) < 10
    news = pseudonymised(spark, *[f"{d:02}.{m:02}.85" for d in range(1, 29) for m in range(1, 13)])
    assert all(n == 1 for _, n in news) and len({t for t, _ in news}) == 28 * 12
    assert all(len(t) == 8 and datetime.datetime.strptime(t, "%d.%m.%y") for t, _ in news)

    phones = [f"{200 + i * 7 % 800}{200 + i * 13 % 800}{i:04}" for i in range(300)]
    news = pseudonymised(spark, *[f"call {p}." for p in phones])
    assert all(n == 1 for _, n in news) and len({t for t, _ in news}) == 300
    assert all(len(t) == 16 and t[5] >= "2" and t[8] >= "2" and t[5:15].isdigit() for t, _ in news)
    stay = ["1234567890", "5551234567.5", "id-5551234567", "31.2.1985", "03/7/1985", "45.13.85", "1.2.10", "13/13/1985"]
    assert pseudonymised(spark, *stay) == [(t, 0) for t in stay]
