"""Pair tables as CSV and tokenised examples as Parquet."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pairloom.schemas import EXAMPLES, PAIRS
from pairloom.sources import csv_format

# Bounds what a lost task has to write again.
ROWS_PER_FILE = 1_000_000


def write_pairs_csv(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """CSV with a header; quotes inside fields are doubled."""
    df.write.mode("errorifexists").options(**csv_format.WRITE).option(
        "maxRecordsPerFile", rows_per_file
    ).csv(path)


def read_pairs_csv(spark: SparkSession, path: str, schema: T.StructType | str = PAIRS) -> DataFrame:
    """Pairs of a file or folder; columns are found by each file's header."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return csv_format.read_by_header(spark, path, schema).select(*schema.names)


def write_examples(df: DataFrame, path: str) -> None:
    """Examples partitioned by task and part, so that a trainer reads only its own folder."""
    df.write.mode("errorifexists").partitionBy("task", "part").parquet(path)


def read_examples(
    spark: SparkSession, path: str, task: str | None = None, part: str | None = None
) -> DataFrame:
    df = spark.read.schema(EXAMPLES).parquet(path)
    for name, value in (("task", task), ("part", part)):
        if value is not None:
            df = df.where(df[name] == value)
    return df
