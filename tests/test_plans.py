from conftest import rows
from pyspark.sql import functions as F

from pairloom.plans.evaluation import evaluate
from pairloom.plans.training import curate_pairs, prepare_examples
from pairloom.sources.pairs import read_examples


def test_training_data(spark, tmp_path):
    def raw(task, n):
        return spark.range(n).select(
            F.col("id").alias("ex_id"),
            F.lit(task).alias("task"),
            F.concat(F.lit("do "), F.repeat(F.lit("x "), (F.col("id") % 9).cast("int"))).alias("prompt"),
            F.when(F.col("id") != 3, F.lit("ok .")).alias("answer"),
            F.lit(0).alias("split_rank"),
            F.col("id").alias("ord"),
        )

    pairs = curate_pairs(raw("task_1", 50), raw("task_2", 80), n=40)
    vocab = prepare_examples(pairs, str(tmp_path / "out"))
    stored = read_examples(spark, str(tmp_path / "out"))
    assert rows(stored.groupBy("task", "part").count()) == [
        ("task_1", "train", 39), ("task_1", "validation", 10), ("task_2", "train", 32), ("task_2", "validation", 8),
    ]
    assert stored.select(F.size("input_ids"), F.size("labels")).distinct().count() == 1
    assert stored.where(F.exists("input_ids", lambda x: x > 1 + vocab.count())).count() == 0
    assert {r.token for r in vocab.collect()} >= {"generate", "code", "docstring", ":", "do", "x", "ok", "."}


def test_evaluation(spark):
    samples = spark.createDataFrame(
        [(1, "code_generation"), (2, "docstring_generation")], "sample_id int, task string"
    )
    refs = spark.createDataFrame([(1, "def f(x):\n    return x"), (2, "Adds two numbers up.")], "sample_id int, reference string")
    gens = spark.createDataFrame(
        [
            (1, "candidate", "code_generation", "```python\ndef f(x):\n    return x\n```\nok", "5", 12.34, 0.0),
            (2, "candidate", "docstring_generation", '"""Adds two numbers up."""', "Score: 4", 7.66, 3.0),
        ],
        "sample_id int, model string, task string, raw_response string, judge_response string, latency_ms double, memory_mb double",
    )
    cases = spark.createDataFrame(
        [(1, "candidate", "1", "1"), (1, "candidate", "2", "3")], "sample_id int, model string, actual string, expected string"
    )
    got = {r.model: tuple(r)[1:] for r in evaluate(samples, gens, refs, cases).collect()}
    assert got == {
        "candidate": (0.5, 1.0, 5.0, 1.0, 4.0, 10.0, 3.0),
        "base": (0.0,) * 7,
        "cloud": (0.0,) * 7,
    }
