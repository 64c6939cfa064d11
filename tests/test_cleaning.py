import pytest
from conftest import one_column, values
from pyspark.sql import functions as F

from pairloom.functions import cleaning

F3 = "```"
FUNCTIONS = [
    ("no function here ", "no function here"),
    (f"Sure.\n{F3}python\ndef f(x):\n    y = x\n\n    return y\n{F3}\nDone", "def f(x):\n    y = x\n\n    return y"),
    ("class A:\n    def g(self):\n        return 1\n    z = 2", "def g(self):\n        return 1"),
    ("def h():\n    return 1\n# note\ndef k():\n    return 2", "def h():\n    return 1"),
    ("def h():\n    return 1\n\n   \n", "def h():\n    return 1"),
    ("async def a():\n    pass", "async def a():\n    pass"),
    ("x = 1\n\tdef t():\n\t\treturn 1\n\tend", "def t():\n\t\treturn 1"),
    ("    def d():\n      a\n   b", "def d():\n      a"),
    (f"{F3}python\n    def f():\n        return 1{F3}", "def f():\n        return 1"),
    (f"{F3}pythonic", "ic"),
    ("def one(): return 1", "def one(): return 1"),
    ("undefined def x", "undefined def x"),
    ("", ""),
    ("def f():\n'''doc'''\n    x", "def f():"),
    ("\u00a0def f():\n\u00a0\u00a0return 1\n\u00a0x", "def f():\n\u00a0\u00a0return 1"),
]
DOCSTRINGS = [
    ('"""Doc."""', "Doc."),
    (f'{F3}python\n"""Doc."""\n{F3}', '"""Doc."""'),
    ('"""', ""),
    ('""""', ""),
    ('"""""', ""),
    ('""""""', ""),
    ("'\"\"\"\"'", '""""'),
    ("'''a'''", "a"),
    ('"a" and "b"', 'a" and "b'),
    ("\"'x'\"", "x"),
    ("'\"x\"'", '"x"'),
    ('"', ""),
    ("'", ""),
    ("  two\nlines  ", "two\nlines"),
    ('"""\n  a\n"""', "a"),
    ("it's", "it's"),
    ("$1 \\ cost", "$1 \\ cost"),
    ('"$1 \\"', "$1 \\"),
]


def test_extract_function(spark):
    df = one_column(spark, [a for a, _ in FUNCTIONS]).withColumn("o", cleaning.extract_function("c"))
    assert values(df, "o") == [b for _, b in FUNCTIONS]


def test_clean_docstring(spark):
    df = one_column(spark, [a for a, _ in DOCSTRINGS]).withColumn("o", cleaning.clean_docstring(F.col("c")))
    assert values(df, "o") == [b for _, b in DOCSTRINGS]


@pytest.mark.parametrize(
    "reply,score",
    [("10", 1), ("6", 0), ("4/5", 4), ("Score: 3", 3), ("", 0), (None, 0), ("0 7 9 5", 5)],
)
def test_judge_score(spark, reply, score):
    df = one_column(spark, [reply]).withColumn("o", cleaning.parse_judge_score(F.col("c")))
    assert values(df, "o") == [score]


def test_function_name(spark):
    df = one_column(spark, ["def abc(x)", "x def \u00e9t\u00e9_1()", "", None, "define"])
    got = values(df.withColumn("o", cleaning.function_name(F.col("c"), F.col("i"))), "o")
    assert got == ["abc", "\u00e9t\u00e9_1", "sample_2", "sample_3", "sample_4"]


def test_truncate_response(spark):
    df = one_column(spark, ["x" * 500, "y" * 501, None])
    got = values(df.withColumn("o", cleaning.truncate_response(F.col("c"), 500)), "o")
    assert got == ["x" * 500, "y" * 500 + "...", ""]


def test_long_texts_stay_linear(spark):
    texts = [" " * 200_000 + "x" + "\n" * 200_000, "def f():\n" + "    y = 1\n" * 20_000]
    df = one_column(spark, texts)
    got = values(df.withColumn("o", F.length(cleaning.extract_function("c"))), "o")
    assert got == [1, len(texts[1]) - 1]
    assert values(df.withColumn("o", F.length(cleaning.clean_docstring(F.col("c")))), "o")[0] == 1
