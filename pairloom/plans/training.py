"""From raw pair tables to stored training examples."""

from pyspark.sql import DataFrame, SparkSession

from pairloom.operators.curate import drop_null_pairs, first_n, length_filter
from pairloom.operators.examples import (
    VOCAB_SIZE,
    assemble_examples,
    build_vocab,
    encode_tokens,
    format_prompt,
    max_length,
    pad_right,
)
from pairloom.operators.split import exact_split
from pairloom.schemas import EXAMPLES, FIRST_N, MAX_PIECES
from pairloom.sources.pairs import write_examples
from pairloom.storage import materialise, scratch_path


def curate_pairs(task_1: DataFrame, task_2: DataFrame, n: int = FIRST_N) -> DataFrame:
    """All pairs of task_1 and the first ``n`` short pairs of task_2."""
    short = first_n(length_filter(drop_null_pairs(task_2), MAX_PIECES), n)
    return drop_null_pairs(task_1).unionByName(short)


def prepare_examples(pairs: DataFrame, out: str, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """Write padded examples by task and part; returns the vocabulary.

    Unpadded examples are stored first: the longest length and the padding both read them.
    """
    spark: SparkSession = pairs.sparkSession
    texts = format_prompt(pairs)
    vocab = materialise(build_vocab(texts, ("model_input", "answer"), vocab_size))
    encoded = encode_tokens(texts, vocab, {"model_input": "prompt_ids", "answer": "answer_ids"})
    store = scratch_path(spark, "examples")
    assemble_examples(encoded).write.parquet(store)
    examples = spark.read.parquet(store)
    padded = pad_right(examples, materialise(max_length(examples)))
    write_examples(exact_split(padded).select(*EXAMPLES.names), out)
    return vocab
