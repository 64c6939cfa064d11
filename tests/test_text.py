import json
import random
import re
from collections import Counter

import pytest
from conftest import plan, one_column, values
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.functions.ngrams import repeat_tags, run_lengths

SAMPLES = [
    "",
    "Hello, World_1!  don't",
    "Ecole E\u0301cole \u00c9COLE na\u00efve",
    "a\u00a0b\u2003c\u3000d",
    "x\x1cy\x1fz\x85w\x0bv",
    "\u2460 \u00bd 3\u0663 _ __ \U0001f600!?",
    "def f(x):\n\treturn x**2 # caf\u00e9",
    "\u4e2d\u6587 \u0435\u0449\u0451 \u0391\u0392",
]


def test_tokens_equal_python_words(spark):
    got = values(one_column(spark, SAMPLES).withColumn("t", text.tokens(F.col("c"))), "t")
    assert got == [re.findall(r"\w+|[^\w\s]", s.lower()) for s in SAMPLES]


def test_tokens_equal_python_words_on_random_text(spark):
    rng = random.Random(7)
    alphabet = "aB1_ .,-\n\t\u00e9\u00df\u00a0\x1d\u2028\u0301\u20ac\u0967\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = one_column(spark, texts)
    assert values(df.withColumn("t", text.tokens(F.col("c"))), "t") == [
        re.findall(r"\w+|[^\w\s]", s.lower()) for s in texts
    ]
    assert values(df.withColumn("t", F.expr(text.tokens_sql("c"))), "t") == [
        re.findall(r"\w+|[^\w\s]", s.lower()) for s in texts
    ]
    assert values(df.withColumn("t", text.strip(F.col("c"))), "t") == [s.strip() for s in texts]
    assert values(df.withColumn("t", text.space_pieces(F.col("c"))), "t") == [len(s.split(" ")) for s in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_run_lengths_and_tags(spark, seed):
    rng = random.Random(seed)
    lists = [[]] + [[rng.choice("abcde") for _ in range(rng.randint(1, 30))] for _ in range(50)]
    df = one_column(spark, lists, "array<string>").select(
        "i", F.expr(run_lengths("c")).alias("r"), F.expr(repeat_tags(run_lengths("c"))).alias("t")
    )
    assert [{x["value"]: x["cnt"] for x in r} for r in values(df, "r")] == [dict(Counter(x)) for x in lists]
    tags = [sorted(f"{g} {k}" for g, n in Counter(x).items() for k in range(2, n + 1)) for x in lists]
    assert [sorted(t) for t in values(df, "t")] == tags


def test_json_equality(spark):
    pairs = [
        ("12", "12.0", True),
        ("12", "13", False),
        ("true", "1", True),
        ("false", "0", True),
        ('"1"', "1", False),
        ("[1, 2]", "[1.0,2]", True),
        ("[1, 2]", "[2, 1]", False),
        ('{"a": 1, "b": [true]}', '{"b": [1], "a": 1.0}', True),
        ('"true"', "true", False),
        ('"a, b"', '"a, b"', True),
        ('"a\\u0041"', '"aA"', True),
        ("null", "null", True),
        ("-0", "0", True),
        ("1e2", "100", True),
        ("plain text", "plain text", True),
        ("plain text", "other text", False),
        ("[]", "[[]]", False),
        ("9007199254740993", "9007199254740992", False),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    got = df.select("a", "b", "want", text.json_equal(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r.a, r.b) for r in got if r.got != r.want] == []
    for a, b, want in pairs[:14]:
        assert (json.loads(a) == json.loads(b)) == want


def test_json_equality_parses_and_casts_only_what_needs_it(spark):
    pairs = [
        ("12.0", "12", True), ("12.00", "12.0", True), ("-7.0", "-7", True), ("0.0", "0", True), ("-0.0", "0", None),
        ("123456789012345.0", "123456789012345", True), ("1234567890123456.0", "1234567890123456", True),
        ("99999999999999999999.0", "99999999999999999999", None), ("1.5", "1.50", True), ("1.0", "10", False),
        ('"[1]"', "[1]", False), ("[1]", "1", False), ("1", "{}", False), ("[1", '"a"', False), ("[1", "[1", True),
        ("true", "1.0", True), ("1e999", "1e999", True), ("[-1e999, null]", "[-1e999,null]", None), (" [1]", "[1.0]", True),
        (None, "[1]", None), ("[1]", None, None), ("nan", "NaN", False), ("1d", "1", False), (" 1", "1", True),
        ("1" + "0" * 40, "1e40", True), ("1" + "0" * 25, "1" + "0" * 25 + ".0", None), ("100", "1e2", True),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    left, right = F.col("a"), F.col("b")
    # Every pair as if nothing were decided before it is parsed.
    parsed = F.when(left == right, True).otherwise(text.canonical_json(left) == text.canonical_json(right))
    for r in df.select("*", text.json_equal(left, right).alias("got"), parsed.alias("parsed")).collect():
        assert r.got == r.parsed and (r.want is None or r.got == r.want), r
    cast = plan(spark.range(1).select(text.canonical_json(F.col("id").cast("string"))))
    assert cast.count("^-?[0-9]") > cast.count("^-?[0-9]+$") > 0


def test_json_equality_of_long_values(spark):
    long = json.dumps("\\n\"x\" " * 50_000)
    numbers = json.dumps(list(range(20_000)))
    pairs = [(long, long[:-1] + ' "', False), (f"[{long}, 1]", f"[{long},1.0]", True), (numbers, numbers.replace(" ", ""), True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    got = df.select("want", text.json_equal(F.col("a"), F.col("b")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
