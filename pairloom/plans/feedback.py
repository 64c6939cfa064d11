"""From daily feedback files to the summary and new training pairs."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.feedback import (
    feedback_pairs,
    feedback_summary,
    feedback_totals,
    parse_feedback,
    rejected_feedback,
    summary_of,
)
from pairloom.schemas import FEEDBACK_RAW
from pairloom.sources import csv_format
from pairloom.sources.feedback import feedback_files, feedback_json_sink, load_feedback_csv, raw_feedback
from pairloom.storage import materialise

FILES_PER_BATCH = 10_000
_TOTALS = "total bigint, positive bigint, task_1 bigint, rejected bigint, batch bigint"


def collect_feedback(spark: SparkSession, directory: str, out_dir: str) -> DataFrame:
    """Write parsed rows and positive pairs; returns the summary."""
    # The files are read once; everything else reads the stored rows.
    rows = materialise(parse_feedback(load_feedback_csv(spark, directory)).drop("file", "pos"))
    feedback_json_sink(rows, feedback_pairs(rows), out_dir)
    return feedback_summary(rows)


def collect_new_feedback(
    spark: SparkSession,
    directory: str,
    out_dir: str,
    checkpoint: str,
    partitioned: bool = False,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """As ``collect_feedback`` for the files that came since the last run with this checkpoint.

    Files are taken in batches. A batch writes its rows (``all_feedback``), its positive pairs
    (``training_pairs``), the rows it rejects with a reason (``rejected``) and its counts (``totals``)
    to folders of its number and overwrites them if it runs again, so a run may stop at any time.
    A file is read by the run that first sees it; what is added to it later is not read. Returns the
    summary of all runs, which adds up the counts and reads no rows.
    """

    def write(text: DataFrame, batch: int) -> None:
        raw = materialise(raw_feedback(csv_format.by_header(text, FEEDBACK_RAW), partitioned))
        rows, bad = parse_feedback(raw), rejected_feedback(raw)
        parts = {"all_feedback": rows.drop("pos"), "training_pairs": feedback_pairs(rows), "rejected": bad.drop("pos")}
        for name, part in parts.items():
            part.write.mode("overwrite").json(f"{out_dir}/{name}/batch={batch}")
        counts = feedback_totals(rows).join(bad.agg(F.count(F.lit(1)).alias("rejected")))
        counts.write.mode("overwrite").parquet(f"{out_dir}/totals/batch={batch}")

    lines = spark.readStream.option("lineSep", csv_format.Csv.separator).option("maxFilesPerTrigger", files_per_batch)
    new = lines.text(feedback_files(directory, partitioned)).select("value", "_metadata")
    query = new.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return summary_of(read_totals(spark, out_dir))


def read_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """The counts of every batch, with the number of rejected rows; none before the first batch."""
    try:
        return spark.read.schema(_TOTALS).parquet(f"{out_dir}/totals")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _TOTALS)
