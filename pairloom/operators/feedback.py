"""User ratings: parsing, summary, training pairs and daily counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import WHITESPACE_CLASS
from pairloom.functions.prompts import training_prompt

# Whole numbers with optional sign, inner underscores and surrounding white space.
RATING_PATTERN = rf"\A{WHITESPACE_CLASS}*([+-]?[0-9]++(?:_[0-9]++)*+){WHITESPACE_CLASS}*\z"


def _rating_text(rating_col: str) -> Column:
    return F.regexp_replace(F.regexp_extract(rating_col, RATING_PATTERN, 1), "_", "")


def _complete(raw: DataFrame) -> Column:
    there = F.lit(True)
    for c in ("timestamp", "task", "prompt", "response"):
        if c in raw.columns:
            there &= F.col(c).isNotNull()
    return there


def parse_feedback(raw: DataFrame, rating_col: str = "rating_raw") -> DataFrame:
    """Ratings as numbers; rows with a missing field or a rating that is no whole number are dropped.

    A rating beyond the bigint range is kept at the end of that range: any value but 1 means negative.
    """
    text = _rating_text(rating_col)
    number = F.coalesce(
        text.try_cast("bigint"),
        F.when(text.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1)),
    )
    return raw.where((text != "") & _complete(raw)).withColumn("rating", number).drop(rating_col)


def rejected_feedback(raw: DataFrame, rating_col: str = "rating_raw") -> DataFrame:
    """The rows that ``parse_feedback`` drops, unchanged, with a ``reason``: ``field`` or ``rating``."""
    reason = F.when(~_complete(raw) | F.col(rating_col).isNull(), "field").when(_rating_text(rating_col) == "", "rating")
    return raw.withColumn("reason", reason).where(F.col("reason").isNotNull())


def feedback_totals(rows: DataFrame) -> DataFrame:
    """One row of counts; those of several parts of the rows may be added up."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("rating") == 1).alias("positive"),
        F.count_if(F.col("task") == "task_1").alias("task_1"),
    )


def feedback_summary(rows: DataFrame) -> DataFrame:
    """One row of totals, none for empty input."""
    return summary_of(feedback_totals(rows))


def summary_of(counts: DataFrame) -> DataFrame:
    """The summary from rows of ``feedback_totals``, none if they count nothing."""
    added = counts.agg(*[F.sum(c).alias(c) for c in ("total", "positive", "task_1")])
    totals = added.where(F.col("total") > 0)
    negative = F.col("total") - F.col("positive")

    def percent(n):
        return F.bround(n / F.col("total") * 100, 0).cast("bigint")

    return totals.select(
        "total",
        "positive",
        negative.alias("negative"),
        percent(F.col("positive")).alias("positive_pct"),
        percent(negative).alias("negative_pct"),
        "task_1",
        (F.col("total") - F.col("task_1")).alias("task_2"),
    )


def feedback_pairs(rows: DataFrame) -> DataFrame:
    """Training text of every positive rating; any task but task_1 uses the docstring format."""
    fmt = F.when(F.col("task") == "task_1", "task_1").otherwise("task_2")
    text = F.concat(training_prompt(fmt, F.col("prompt")), F.col("response"))
    return rows.where(F.col("rating") == 1).select("task", text.alias("text"))


def feedback_daily_counts(rows: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Rows per day and task; a time that is none counts under a null day."""
    return rows.groupBy(F.col(ts_col).try_cast("date").alias("day"), "task").agg(F.count(F.lit(1)).alias("n_rows"))
