"""Collection of ratings as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.feedback import feedback_daily_counts
from pairloom.schemas import FEEDBACK_RAW
from pairloom.sources import csv_format

ROWS_PER_FILE = 5_000_000
FILES_PER_DAY = 8


def read_feedback_stream(
    spark: SparkSession,
    in_dir: str,
    fmt: str = "csv",
    schema: T.StructType = FEEDBACK_RAW,
    name_glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(**csv_format.READ)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(in_dir)


def feedback_append_stream(
    ratings: DataFrame,
    out_dir: str,
    checkpoint: str,
    ts_col: str = "timestamp",
    files_per_day: int = FILES_PER_DAY,
) -> StreamingQuery:
    """Append every rating to the folder of its day, exactly once; ends when the input is read.

    A time that is none goes to the folder of the null day. Days are dealt to ``files_per_day`` tasks
    each, so a batch adds at most so many files to a day, however many tasks read it.
    """
    share = F.pmod(F.xxhash64(*ratings.columns), F.lit(files_per_day))
    return (
        ratings.withColumn("day", F.col(ts_col).try_cast("date"))
        .repartition("day", share)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("day")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out_dir)
    )


def daily_counts_stream(ratings: DataFrame, ts_col: str = "ts", late: str | None = None) -> DataFrame:
    """Running rows per day and task. State is one count per open day and task.

    Without ``late`` no rating is ever dropped, every day stays open, and a time that is none counts
    under a null day (complete or update mode); with it, ratings that come later than that are
    ignored, as append mode needs.
    """
    if late is None:
        return feedback_daily_counts(ratings, ts_col)
    return (
        ratings.withWatermark(ts_col, late)
        .groupBy(F.window(ts_col, "1 day").alias("w"), "task")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.to_date("w.start").alias("day"), "task", "n_rows")
    )


def keep_daily_counts(ratings: DataFrame, out_dir: str, checkpoint: str, ts_col: str = "ts") -> StreamingQuery:
    """Keep counts per day and task up to date in a table; ends when the input is read.

    A batch writes the counts that it changed to a folder of its own and overwrites it if it runs
    again, so the table survives a stop at any time. ``read_daily_counts`` takes the newest ones.
    """

    def write(counts: DataFrame, batch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{out_dir}/batch={batch}")

    writer = daily_counts_stream(ratings, ts_col).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(availableNow=True).start()


def read_daily_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """``day``, ``task``, ``n_rows`` as of the newest batch."""
    stored = spark.read.schema("day date, task string, n_rows bigint, batch bigint").parquet(out_dir)
    return stored.groupBy("day", "task").agg(F.max_by("n_rows", "batch").alias("n_rows"))
