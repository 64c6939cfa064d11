import public_tokenizers
import pytest
from conftest import plan, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.operators import encoding
from pairloom.operators import examples as ex

TEXTS = [
    (1, "task_1", "add two numbers", "a + b"),
    (2, "task_1", "", "a"),
    (3, "task_2", "def f(): return a", "Returns a."),
    (4, "other", "a a a", ""),
    (5, "task_2", "unknown Ünïcode", "a"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(TEXTS, "ex_id bigint, task string, prompt string, answer string")


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(
        [("a", 9, 2), ("+", 5, 3), ("returns", 4, 4), (".", 3, 5), ("def", 1, 6)], "token string, cnt bigint, id int"
    )


def encoded(pairs, vocab, **kw):
    return ex.encode_tokens(pairs, vocab, {"prompt": "prompt_ids", "answer": "answer_ids"}, **kw)


def test_prompt_formats(pairs):
    got = {r.ex_id: r.model_input for r in ex.format_prompt(pairs).collect()}
    assert got[1] == "Generate code: add two numbers\nCode: "
    assert got[3] == "Generate docstring: def f(): return a\nDocstring: "
    assert got[4] == "a a a"
    padded = pairs.withColumn("prompt", F.concat(F.lit(" \n"), "prompt", F.lit(" ")))
    assert {r.ex_id: r.model_input for r in ex.format_prompt(padded, strip=True).collect()} == got


def test_vocabulary_order_and_cap(spark):
    df = spark.createDataFrame([("b a b", "c"), ("a d d", "d"), (None, "z")], "x string, y string")
    full = ex.build_vocab(df, ("x", "y"), 10).orderBy("id").collect()
    want = [("d", 3, 2), ("a", 2, 3), ("b", 2, 4), ("c", 1, 5), ("z", 1, 6)]
    assert [(r.token, r.cnt, r.id) for r in full] == want
    for cap in range(1, 6):
        assert rows(ex.build_vocab(df, ("x", "y"), cap)) == sorted(want[:cap], key=repr)
    assert rows(ex.build_vocab(df, ("x", "y"), 2).select("token")) == [("a",), ("d",)]


def test_encoding(pairs, vocab):
    got = {r.ex_id: (r.prompt_ids, r.answer_ids) for r in encoded(pairs, vocab).collect()}
    assert got[1] == ([0, 0, 0], [2, 3, 0])
    assert got[2] == ([], [2])
    assert got[3][1] == [4, 2, 5]
    assert got[4] == ([2, 2, 2], [])
    assert got[5] == ([0, 0], [2])


def test_encoding_by_join_equals_encoding_in_place(pairs, vocab):
    in_place = encoded(pairs, vocab)
    joined = encoded(pairs, vocab, max_rows=1, min_rows=2)
    assert rows(joined.select(in_place.columns)) == rows(in_place)
    assert "Exchange" not in plan(in_place)


def test_both_ways_of_encoding_keep_null_and_repeated_keys(spark, vocab):
    df = spark.createDataFrame(
        [(1, "a b", "a"), (1, "a", ""), (None, "b", None), (None, "b", None), (2, None, "returns a .")],
        "ex_id bigint, prompt string, answer string",
    )
    in_place = rows(encoded(df, vocab))
    assert len(in_place) == 5
    for min_rows in (None, 1):
        assert rows(encoded(df, vocab, max_rows=0, min_rows=min_rows)) == in_place


def test_padding_keeps_rows_without_a_task(pairs, vocab):
    made = ex.assemble_examples(encoded(pairs.withColumn("task", F.lit(None).cast("string")), vocab))
    assert {len(r.input_ids) for r in ex.pad_right(made).collect()} == {11}
    assert ex.pad_right(made).count() == 5


def test_empty_vocabulary(pairs, vocab):
    got = encoded(pairs, vocab.where("false")).where("ex_id = 1").first()
    assert got.prompt_ids == [0, 0, 0]


def test_examples_and_padding(pairs, vocab):
    made = ex.assemble_examples(encoded(pairs, vocab))
    got = {r.ex_id: r for r in made.collect()}
    assert got[1].input_ids == [0, 0, 0, 2, 3, 0, 1]
    assert got[1].labels == [-100, -100, -100, 2, 3, 0, 1]
    assert got[2].input_ids == [2, 1] and got[2].labels == [2, 1]
    assert rows(ex.max_length(made)) == [("other", 4), ("task_1", 7), ("task_2", 11)]
    padded = {r.ex_id: r for r in ex.pad_right(made).collect()}
    assert padded[2].input_ids == [2, 1, 0, 0, 0, 0, 0]
    assert padded[2].attention_mask == [1, 1, 0, 0, 0, 0, 0]
    assert padded[2].labels == [2, 1, -100, -100, -100, -100, -100]
    for r in padded.values():
        assert len(r.input_ids) == len(r.attention_mask) == len(r.labels)
        assert sum(r.attention_mask) == len(got[r.ex_id].input_ids)


def test_truncation(pairs, vocab):
    cut = ex.truncate_tokens(ex.assemble_examples(encoded(pairs, vocab)), 2).collect()
    assert {len(r.input_ids) for r in cut} == {2}
    assert max(len(r.labels) for r in cut) == 11


def test_ids_of_a_stored_tokeniser_give_the_text_back(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", None, "a", "  two  words \n\n\t x", "<|endoftext|> end", "\u00c4\u0308 \u6f22\U0001f600\u200d\x00\x85", "don't " * 500, "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string").repartition(3)
    coded = encoding.encode_with(df, path, {"c": "ids"})
    whole = Tokenizer.from_file(path)
    for r in coded.collect():
        assert r.ids == whole.encode(r.c or "", add_special_tokens=False).ids
    back = encoding.decode_with(coded, path, {"ids": "text"})
    assert all(r.text == (r.c or "") for r in back.collect())
    none = encoding.decode_with(spark.createDataFrame([(None,)], "ids array<int>"), path, {"ids": "text"})
    assert none.first().text is None and encoding.encode_with(df.limit(0), path, {"c": "ids"}).count() == 0


def test_slices_of_a_batch_encode_alike(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"text {i} " * (i % 7) if i % 11 else None for i in range(300)] + ["long " * 400, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string").coalesce(1)
    monkeypatch.setattr(encoding, "SLICE", 64)
    coded = encoding.encode_with(df, path, {"c": "ids"})
    whole = Tokenizer.from_file(path)
    got = encoding.decode_with(coded, path, {"ids": "text"}).collect()
    assert len(got) == len(texts)
    assert all(r.ids == whole.encode(r.c or "", add_special_tokens=False).ids and r.text == (r.c or "") for r in got)
    odd = coded.withColumn("ids", F.when(F.col("i") % 2 == 0, F.col("ids")))
    assert all(r.text == ((r.c or "") if r.i % 2 == 0 else None) for r in encoding.decode_with(odd, path, {"ids": "text"}).collect())
