"""Daily feedback files and the outputs of a feedback run."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.schemas import FEEDBACK_RAW
from pairloom.sources import csv_format

NAME_PATTERN = "feedback_*.csv"
# Bounds what a lost task has to write again.
ROWS_PER_FILE = 1_000_000


def feedback_files(directory: str, partitioned: bool = False) -> str:
    """The files of a feedback folder; ``partitioned`` is the layout of ``write_feedback_csv``."""
    return f"{directory}/file={NAME_PATTERN}/*.csv" if partitioned else f"{directory}/{NAME_PATTERN}"


def load_feedback_csv(spark: SparkSession, directory: str, partitioned: bool = False) -> DataFrame:
    """Rows of all files named ``feedback_*.csv``, with the file name; other files are not opened.

    Columns are found by header. Rows are not sorted: ``file``, then ``pos``, is the order of the source.
    """
    return raw_feedback(csv_format.read_by_header(spark, feedback_files(directory, partitioned), FEEDBACK_RAW), partitioned)


def raw_feedback(rows: DataFrame, partitioned: bool = False) -> DataFrame:
    """Rows read by header as ``file``, ``pos``, the texts and ``rating_raw``."""
    # A bare empty field is an empty text here. A row that ends early lacks its rating.
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in FEEDBACK_RAW.names[:-1]]
    name = F.regexp_extract(F.col("_path"), rf"/{'file=' if partitioned else ''}(feedback_[^/]*\.csv)", 1)
    return rows.select(
        F.url_decode(name).alias("file"), F.col("_pos").alias("pos"), *texts, F.col("rating").alias("rating_raw")
    )


def write_feedback_csv(df: DataFrame, directory: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Rows below one folder per daily file name (column ``file``).

    Rows of a day are brought together up to the size of a partition, so a day has few files and a
    busy day still is written by several tasks.
    """
    columns = ["file", *FEEDBACK_RAW.names]
    dealt = df.select(*columns).hint("rebalance", F.col("file"))
    writer = dealt.write.mode("append").options(**csv_format.WRITE).option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy("file").csv(directory)


def feedback_json_sink(rows: DataFrame, pairs: DataFrame, out_dir: str) -> list[str]:
    """Write all rows and the training pairs as JSON lines; nothing is written for an empty table.

    Each table is asked for twice: pass materialised rows and pairs made from them.
    """
    written = []
    for name, df in (("all_feedback", rows), ("training_pairs", pairs)):
        if not df.isEmpty():
            df.write.mode("errorifexists").json(f"{out_dir}/{name}")
            written.append(name)
    return written
