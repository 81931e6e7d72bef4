import functools
import operator
import random

import pytest
from conftest import row
from pyspark.sql import functions as F

from bucketscope.functions.regex import compile_pattern, literal_head, to_java
from bucketscope.operators.filters import FilterConfig, apply_filters

CASES = [
    # pattern, text, found
    (r"\.csv$", "a.csv", True),
    (r"\.csv$", "a.csv\n", False),
    (r"(?m)\.csv$", "a.csv\nb", True),
    (r"(?m)^b$", "a\nb\nc", True),
    (r"(?m)^$", "a\n", True),
    (r"^b", "a\nb", False),
    (r"(?m:^b)|^c", "a\nb", True),
    (r"(?m:a)$", "a\nb", False),
    (r"^\w+$", "données", True),
    (r"(?-u)^\w+$", "données", False),
    (r"^\d$", "٣", True),
    (r"a.b", "a\rb", True),
    (r"a.b", "a\nb", False),
    (r"(?s)a.b", "a\nb", True),
    (r"(?i)É", "é", True),
    (r"(?i:abc)D", "ABCD", True),
    (r"[[:alpha:]]+[[:digit:]]", "ab1", True),
    (r"^[[:alpha:]]+$", "é", False),
    (r"^[^[:digit:]]$", "1", False),
    (r"[$]", "a$", True),
    (r"\$", "a$", True),
    (r"[]a]", "]", True),
    (r"(?P<first_part>a)(?P=first_part)", "aa", True),
    (r"(?<x_1>a)\k<x_1>", "ab", False),
    (r"(a)\1", "aa", True),
    (r"^(?!tmp/).*\.log$", "tmp/a.log", False),
    (r"^(?!tmp/).*\.log$", "var/a.log", True),
    (r"(?<=/)x", "a/x", True),
    (r"^\h+$", "c0ffee", True),
    (r"\p{Greek}", "λ", True),
    (r"\p{Lu}", "a", False),
    (r"\pL", "a", True),
    (r"\u{e9}", "é", True),
    (r"\x{1F600}", "😀", True),
    (r"^.$", "😀", True),
    (r"(?U)a+", "aa", True),
    (r"(?x) a  b ", "ab", True),
    (r"\bcat\b", "a cat", True),
    (r"foo\Kbar", "foobar", True),
    (r"a$|b", "xb", True),
]


def test_patterns_find_what_the_source_dialect_finds(spark):
    for pattern, text, found in CASES:
        df = spark.range(1).select(F.lit(text).rlike(to_java(pattern)).alias("hit"))
        assert df.first()["hit"] is found, (pattern, text, to_java(pattern))


@pytest.mark.parametrize("pattern", ["a\\", "[a", "[a--b]", r"(?R)a", r"\b{start}a", "(?P=none)", "[[:nope:]]"])
def test_unsupported_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        to_java(pattern)


@pytest.mark.parametrize(
    "pattern, head",
    [
        ("^data/2024", "data/2024"),
        (r"^a\.b", "a.b"),
        ("^ab?c", "a"),
        ("^a*", None),
        ("^a|b", None),
        ("data", None),
        ("(?i)^data", None),
        ("^data/.*x", "data/"),
    ],
)
def test_literal_head(pattern, head):
    assert literal_head(pattern) == head


@pytest.mark.parametrize("pattern", [
    "(abc", "a{2,1}", "*a", "a)", "|*", "(?<n", "(?i)*", "(*a)", "a|+", r"\x{110000}", r"\xZZ", r"\Qa", r"\p{Lu", "(?:a", "(?=a", "a(b(c)", "[b-a]", r"\p{Nope}", "(?z)a",
])
def test_malformed_patterns_are_refused_when_the_filter_is_built(spark, pattern):
    for field in ("include_regex", "exclude_regex"):
        with pytest.raises(ValueError):
            FilterConfig(**{field: pattern})


@pytest.mark.parametrize("pattern, begins, ends, holds", [
    ("^data/(a|b)/x+", "data/", None, ("/x",)), (r"\.csv$", None, ".csv", ()), (r"^\x41b\.", "Ab.", None, ()),
    ("(?i)abc1", None, None, ("1",)), ("(?i:a)bc", None, None, ("bc",)), ("a(?i)b|c", None, None, ()), ("(?x) a b # c", None, None, ("ab",)),
    ("(foo)?bar", None, None, ("bar",)), ("(?:foo)bar$", None, "foobar", ()), ("x{,3}y", None, None, ("y",)), ("x{", None, None, ("x{",)),
    ("a(?=b)c", None, None, ("ac",)), (r"\pNy", None, None, ("y",)), ("(?m)^a$", None, None, ("a",)), ("(ab)+c", None, None, ("ab", "c")),
    (r"[a-z]+/part-[0-9]+\.parquet", None, None, (".parquet", "/part-")), ("a**b", None, None, ("b",)), (r"(a)\12", None, None, ("a",)),
])
def test_texts_that_every_match_holds(pattern, begins, ends, holds):
    found = compile_pattern(pattern)
    assert (found.begins, found.ends, found.holds) == (begins, ends, holds)


def test_texts_drop_no_match(spark):
    """On made-up patterns and keys, whatever a pattern finds passes the tests for its texts."""
    rng = random.Random(6)

    def made(depth=3):
        kind = rng.randrange(9 if depth else 3)
        if kind < 3:
            return rng.choice(["a", "b", "/", r"\.", "[ab]", ".", "^", "$", "ab", r"\x61", r"\b", "(?i)"])
        if kind < 6:
            return made(depth - 1) + made(depth - 1)
        if kind == 6:
            return "(?:" + made(depth - 1) + ")" + rng.choice(["?", "*", "+", "{2}", "{0,1}", "{1,}?"])
        if kind == 7:
            return f"({made(depth - 1)}|{made(depth - 1)})"
        return rng.choice(["(?=", "(?!", "(?i:", "(?:"]) + made(depth - 1) + ")"

    keys = ["".join(rng.choice("abAB/.") for _ in range(rng.randrange(7))) for _ in range(400)]
    df = spark.createDataFrame([("b", "OBJECT", k) for k in {*keys}], "bucket string, entry_type string, key string")
    lost, found, texts = [], 0, 0
    for pattern in {made() for _ in range(150)}:
        tests = FilterConfig(include_regex=pattern).key_texts()
        held = functools.reduce(operator.and_, tests, F.lit(True))
        hits = df.where(F.col("key").rlike(to_java(pattern)))
        missed, all_hits = hits.agg(F.count_if(~held), F.count("*")).first()
        found, texts = found + all_hits, texts + bool(tests)
        if missed:
            lost.append(pattern)
    assert not lost and found > 1000 and texts > 20


def test_texts_reach_the_scan(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    rows(row("logs/a.csv"), row("logs/part-1.csv"), row("x")).write.parquet(path)
    df = spark.read.parquet(path)
    for pattern, pushed, wanted in ((r"part-\d\.csv$", "StringContains(key,part-)", 1), (r"^logs/.*\.csv$", "StringEndsWith(key,.csv)", 2)):
        found = apply_filters(df, FilterConfig(include_regex=pattern))
        assert found.count() == wanted
        assert pushed in found._jdf.queryExecution().executedPlan().toString()
