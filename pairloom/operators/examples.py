"""Vocabulary, token ids and padded, label-masked training examples."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.prompts import training_prompt
from pairloom.functions.text import strip as strip_text
from pairloom.functions.text import tokens
from pairloom.operators.joins import fits_broadcast, lookup_join, salted_join
from pairloom.schemas import EOS_ID, FIRST_TOKEN_ID, IGNORE_LABEL, PAD_ID, UNK_ID
from pairloom.storage import materialise

VOCAB_SIZE = 50_000
_IDS = T.ArrayType(T.IntegerType(), containsNull=False)


def format_prompt(
    df: DataFrame, strip: bool = False, text_col: str = "prompt", out: str = "model_input"
) -> DataFrame:
    """Add the text in the training format of its task."""
    text = strip_text(F.col(text_col)) if strip else F.col(text_col)
    return df.withColumn(out, training_prompt(F.col("task"), text))


def build_vocab(df: DataFrame, cols: tuple[str, ...], max_size: int = VOCAB_SIZE) -> DataFrame:
    """The ``max_size`` most frequent tokens with ids from 2 on, by count and then token.

    Ids 0 and 1 stay free for unknown/padding and end of text.
    """
    # explode_outer: a plain explode adds a filter that tokenises every text once more.
    texts = [tokens(F.coalesce(F.col(c), F.lit(""))) for c in cols]
    words = df.select(F.explode_outer(F.concat(*texts)).alias("token"))
    counts = words.where(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    # Distinct counts are few (k of them need k*(k+1)/2 tokens), so the lowest one that can still
    # enter the list is cheap to find; without it every partition would send max_size candidates.
    most_first = Window.partitionBy(F.lit(0)).orderBy(F.desc("cnt"))
    lowest = (
        counts.groupBy("cnt")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(most_first) - F.col("n"))
        .where(F.col("before") < max_size)
        .agg(F.min("cnt"))
    )
    kept = (
        counts.where(F.col("cnt") >= lowest.scalar()).orderBy(F.desc("cnt"), "token").limit(max_size)
    )
    # Only the capped list is numbered, never the corpus.
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("cnt"), "token"))
    return kept.select("token", "cnt", (rank + (FIRST_TOKEN_ID - 1)).cast("int").alias("id"))


def _encode_in_place(df: DataFrame, vocab: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Look tokens up inside each task, with the vocabulary in a broadcast variable."""
    table = vocab.select("token", F.col("id").cast("int").alias("id")).toArrow().combine_chunks()
    words, ids = (
        table.column(c).combine_chunks() if table.num_rows else pa.array([], t)
        for c, t in (("token", pa.string()), ("id", pa.int32()))
    )
    shared = df.sparkSession.sparkContext.broadcast((words, ids))

    @F.arrow_udf(_IDS)
    def encode(batch: pa.Array) -> pa.Array:
        known, numbers = shared.value
        at = pc.index_in(batch.flatten(), value_set=known.cast(batch.type.value_type))
        found = pc.fill_null(pc.take(numbers, at), UNK_ID)
        starts = batch.offsets
        return pa.ListArray.from_arrays(pc.subtract(starts, starts[0]), found)

    return df.withColumns({out: encode(tokens(F.coalesce(F.col(c), F.lit("")))) for c, out in cols.items()})


def _encode_by_join(
    df: DataFrame, vocab: DataFrame, cols: dict[str, str], min_rows: int | None
) -> DataFrame:
    """Look tokens up with a shuffle, for vocabularies of any size.

    Rows are told apart by a number that is stored with them, so keys may be null or repeated.
    """
    out = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
    numbered = out
    for col, ids_col in cols.items():
        words = numbered.select("_row", F.posexplode(tokens(F.coalesce(F.col(col), F.lit("")))).alias("pos", "token"))
        ids = (
            salted_join(words, vocab.select("token", "id"), ["token"], "left", min_rows)
            .groupBy("_row")
            .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(UNK_ID)).cast("int").alias("id")))).alias("_ids"))
            .select("_row", F.transform("_ids", lambda s: s["id"]).alias(ids_col))
        )
        # A text without tokens has no row on the right.
        out = out.join(ids, "_row", "left").withColumn(ids_col, F.coalesce(ids_col, F.array().cast(_IDS)))
    return out.drop("_row")


def encode_tokens(
    df: DataFrame,
    vocab: DataFrame,
    cols: dict[str, str],
    max_rows: int = 1_000_000,
    max_bytes: int = 128 * 1024 * 1024,
    min_rows: int | None = None,
) -> DataFrame:
    """Add id arrays: ``cols`` maps text columns to output columns. Unknown tokens get id 0.

    A vocabulary within the measured bounds is shipped to the tasks and nothing is shuffled; a
    larger one is joined token by token. Both ways return the same rows, repeated ones and those with
    null keys included. ``vocab`` is read more than once: materialise or store it.
    """
    if fits_broadcast(vocab, max_rows, max_bytes):
        return _encode_in_place(df, vocab, cols)
    return _encode_by_join(df, vocab, cols, min_rows)


def assemble_examples(
    df: DataFrame, prompt_ids: str = "prompt_ids", answer_ids: str = "answer_ids"
) -> DataFrame:
    """Prompt, answer and end token; the prompt is masked out of the labels."""
    end = F.array(F.lit(EOS_ID))
    answer = F.concat(F.col(answer_ids), end)
    ids = F.concat(F.col(prompt_ids), answer)
    return df.select(
        *[c for c in df.columns if c not in (prompt_ids, answer_ids, "prompt", "answer", "model_input")],
        ids.alias("input_ids"),
        F.array_repeat(F.lit(1), F.size(prompt_ids) + F.size(answer_ids) + 1).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(IGNORE_LABEL), F.size(prompt_ids)), answer).alias("labels"),
    )


def max_length(df: DataFrame, group: str = "task") -> DataFrame:
    return df.groupBy(group).agg(F.max(F.size("input_ids")).alias("max_len"))


def pad_right(df: DataFrame, lengths: DataFrame | None = None, group: str = "task") -> DataFrame:
    """Pad all three arrays to the longest example of the group; rows without a group are one.

    Without ``lengths`` the examples are read twice: pass stored examples, or lengths known already.
    """
    lengths = materialise(max_length(df, group)) if lengths is None else lengths
    joined = lookup_join(df, lengths, [group], null_safe=True)
    fill = F.col("max_len") - F.size("input_ids")

    def padded(col: str, value: int) -> Column:
        return F.concat(F.col(col), F.array_repeat(F.lit(value), fill)).alias(col)

    return joined.select(
        *[c for c in df.columns if c not in ("input_ids", "attention_mask", "labels")],
        padded("input_ids", PAD_ID),
        padded("attention_mask", 0),
        padded("labels", IGNORE_LABEL),
    )


def truncate_tokens(
    df: DataFrame, n: int, cols: tuple[str, ...] = ("input_ids", "attention_mask")
) -> DataFrame:
    """Keep the first ``n`` entries of each array."""
    return df.withColumns({c: F.slice(c, 1, n) for c in cols})
