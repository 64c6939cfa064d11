"""Evaluation samples from JSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.schemas import CODE_TASK, DOC_TASK, EVAL_SAMPLE
from pairloom.sources import json_array
from pairloom.sources.blocks import any_large, large_files


def load_eval_set(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Samples of both tasks. Files hold one JSON array each, or one sample per line (``lines``).

    An array that is large enough to be dealt in blocks is read by several tasks. A file that is no
    JSON, or has a field of another type, fails the job.
    """
    reader = spark.read.schema(EVAL_SAMPLE).option("mode", "FAILFAST")
    rows = reader.option("multiLine", not lines).json(path)
    if lines or not any_large(spark, path):
        return rows
    small = rows.where(F.col("_metadata.file_size") <= large_files(spark))
    element = F.from_json("element", EVAL_SAMPLE, {"mode": "FAILFAST"})
    large = json_array.read_elements(spark, path).select(element.alias("s")).select("s.*")
    return small.select(*EVAL_SAMPLE.names).unionByName(large)


def code_samples(df: DataFrame) -> DataFrame:
    return df.where(F.col("task") == CODE_TASK).select(
        "id", "prompt", "function_name", "reference_code", "test_cases"
    )


def docstring_samples(df: DataFrame) -> DataFrame:
    return df.where(F.col("task") == DOC_TASK).select("id", "code", "reference_docstring")


def explode_test_cases(df: DataFrame) -> DataFrame:
    """One row per test case; input and expected value are JSON text."""
    return df.select("id", F.posexplode("test_cases").alias("case_idx", "case")).select(
        "id",
        "case_idx",
        F.to_json("case.input").alias("input"),
        F.to_json("case.expected").alias("expected"),
    )
