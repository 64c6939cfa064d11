"""Cleaning and scoring of generations and test outcomes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.bleu import bleu_score, reference_profile
from pairloom.functions.cleaning import clean_docstring, extract_function
from pairloom.functions.prompts import chat_prompt, judge_prompt
from pairloom.functions.ngrams import let, per_order, run_starts
from pairloom.functions.text import json_equal, tokens, tokens_sql
from pairloom.operators.joins import BROADCAST_BYTES, lookup_join
from pairloom.schemas import BLEU_ORDER, CODE_TASK

# A profile repeats each token in up to ten n-gram places, plus array overhead.
PROFILE_GROWTH = 32


def tokenize_text(df: DataFrame, col: str, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokens(F.col(col)))


def ngram_counts(df: DataFrame, key: str, tok: str, max_n: int = BLEU_ORDER) -> DataFrame:
    """One row per text, order and distinct n-gram with its count.

    Counting happens inside the row that holds the text, so nothing is shuffled. n-grams are tokens
    joined by a space, which no token contains.
    """

    def entry(grams: str, n: int) -> str:
        return let("s", f"sort_array({grams})", f"named_struct('grams', s, 'starts', {run_starts('s')})")

    # The outer forms add no filter that would sort every text a second time.
    orders = df.select(key, F.posexplode_outer(F.expr(per_order(f"`{tok}`", max_n, entry))).alias("_at", "_order"))
    # One row per run: its value and length are looked up in generated code, not built per element.
    found = orders.select(key, "_at", F.col("_order.grams").alias("_grams"), F.col("_order.starts").alias("_starts"))
    runs = found.select("*", F.posexplode_outer("_starts").alias("_run", "_start"))
    start, grams = F.col("_start"), F.col("_grams")
    end = F.coalesce(F.get("_starts", F.col("_run") + 1), F.size(grams))
    return runs.where(start.isNotNull()).select(
        key, (F.col("_at") + 1).alias("n"), F.get(grams, start).alias("gram"), (end - start).alias("cnt")
    )


def reference_profiles(refs: DataFrame, on: list[str], col: str = "reference") -> DataFrame:
    """Per reference its length, distinct n-grams and repeat tags; computed once per reference."""
    toks = refs.select(*on, F.expr(tokens_sql(f"`{col}`")).alias("_tokens"))
    return toks.select(*on, F.expr(reference_profile("_tokens")).alias("_profile"))


def bleu(
    hyps: DataFrame,
    refs: DataFrame,
    on: list[str],
    hyp_col: str = "hypothesis",
    ref_col: str = "reference",
    out: str = "bleu",
) -> DataFrame:
    """Add the BLEU-4 score, rounded to 4 places, of each row against the reference of its key.

    A row whose key is null or has no reference keeps its place and has no score (null). ``refs`` has
    one row per key. References that fit a broadcast go to the rows; others are joined
    with hot keys salted. The score itself needs no further shuffle.
    """
    profiles = reference_profiles(refs, on, ref_col)
    joined = lookup_join(
        hyps, profiles, on, "left", max_bytes=BROADCAST_BYTES // PROFILE_GROWTH, size_of=refs.select(*on, ref_col)
    )
    score = F.expr(bleu_score(tokens_sql(f"`{hyp_col}`"), "_profile"))
    scored = F.when(F.col("_profile").isNotNull(), F.round(score, 4))
    return joined.withColumn(out, scored).drop("_profile")


def clean_output(df: DataFrame, col: str = "raw_response", out: str = "generated") -> DataFrame:
    """Code for code tasks, plain docstring text for the others."""
    cleaned = F.when(F.col("task") == CODE_TASK, extract_function(f"`{col}`"))
    return df.withColumn(out, cleaned.otherwise(clean_docstring(F.col(col))))


def chat_prompts(df: DataFrame, text_col: str = "prompt") -> DataFrame:
    return df.withColumn("chat_prompt", chat_prompt(F.col("task"), F.col(text_col)))


def judge_prompts(
    df: DataFrame,
    source_col: str = "prompt",
    reference_col: str = "reference",
    generated_col: str = "generated",
) -> DataFrame:
    filled = judge_prompt(
        F.col("task"), F.col(source_col), F.col(reference_col), F.coalesce(F.col(generated_col), F.lit(""))
    )
    return df.withColumn("judge_prompt", filled)


def test_pass_rate(samples: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Passed and total cases and their rate per key; a sample without outcomes has rate 0.

    A case without ``actual`` raised an error. Counting precedes the join.
    """
    ok = F.coalesce(json_equal(F.col("actual"), F.col("expected")), F.lit(False))
    counted = outcomes.groupBy(*keys).agg(
        F.count_if(ok).alias("test_passed"), F.count(F.lit(1)).alias("test_total")
    )
    joined = samples.join(counted, keys, "left").fillna(0, ["test_passed", "test_total"])
    rate = F.when(F.col("test_total") == 0, F.lit(0.0)).otherwise(
        F.round(F.col("test_passed") / F.col("test_total"), 4)
    )
    return joined.withColumn("pass_rate", rate)


test_pass_rate.__test__ = False  # not a test case
