"""Evaluation results, run records and the versioned baseline."""

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.cleaning import truncate_response
from pairloom.operators.gate import gate_verdict, metrics_diff, params_diff, promote_baseline, regression_gate
from pairloom.operators.joins import lookup_join
from pairloom.operators.results import long_metrics
from pairloom.schemas import METRICS, MODELS, RESPONSE_LIMIT
from pairloom.storage import materialise


def run_config(
    spark: SparkSession, base_model: str, adapters: list[str], judge_model: str | None, samples: DataFrame
) -> DataFrame:
    """One row describing the evaluation."""
    return samples.agg(F.count(F.lit(1)).alias("num_samples")).select(
        F.lit(base_model).alias("base_model"),
        F.array(*[F.lit(a) for a in adapters]).cast("array<string>").alias("adapters"),
        F.lit(judge_model).cast("string").alias("judge_model"),
        "num_samples",
    )


def results_json_sink(
    results: DataFrame,
    metrics: DataFrame,
    config: DataFrame,
    path: str,
    models: tuple[str, ...] = MODELS,
) -> None:
    """The parts config, metrics and results of a results document, as folders of JSON lines.

    Raw responses in the nested records are cut to the stored length.
    """
    cut = results.withColumns(
        {
            m: F.when(
                F.col(m).isNotNull(),
                F.col(m).withField(
                    "raw_response", truncate_response(F.col(m)["raw_response"], RESPONSE_LIMIT)
                ),
            )
            for m in models
        }
    )
    for name, df in (("config", config), ("metrics", metrics), ("results", cut)):
        df.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{path}/{name}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Metrics (model, metric, value) of results documents.

    ``path`` is a file with one JSON document ``{config, metrics: {model: {metric: number}}, results}``
    each, of which only the metrics are read into rows, or a folder of ``results_json_sink``. A metric that is
    null is left out; a document without metrics has no rows.
    """
    try:
        stored = spark.read.schema(_STORED_METRICS).json(f"{path}/metrics")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        documents = spark.read.schema("metrics map<string, map<string, double>>").option("multiLine", True).option("mode", "FAILFAST")
        rows = documents.json(path).select(F.explode("metrics").alias("model", "m"))
        return rows.select("model", F.explode("m").alias("metric", "value")).where(F.col("value").isNotNull())
    return long_metrics(stored, ("model",)).where(F.col("value").isNotNull())


def gate_documents(spark: SparkSession, new: str, baseline: str | None, model: str) -> DataFrame:
    """The regression gate between one model's metrics in two stored results documents."""

    def of(path: str) -> DataFrame:
        return read_results(spark, path).where(F.col("model") == model).select("metric", "value")

    return regression_gate(of(new), of(baseline) if baseline else None)


def _put_runs(rows: DataFrame, path: str) -> None:
    """Write rows below the folders of their runs; what these held before is replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def append_run_record(record: DataFrame, path: str) -> None:
    """Add (run_id, key, value) rows; a run that is there already is replaced, not doubled."""
    _put_runs(record, path)


def append_run_metrics(metrics: DataFrame, path: str) -> None:
    """Add (run_id, model, metric, value) rows; a run that is there already is replaced, not doubled."""
    _put_runs(metrics, path)


_STORED_METRICS = ", ".join(["model string", *(f"`{m}` double" for m in METRICS)])
_RECORD = "key string, value string, run_id string"
_RUN_METRICS = "model string, metric string, value double, run_id string"


def read_runs(spark: SparkSession, path: str, *run_ids: str, metrics: bool = False) -> DataFrame:
    """Stored records, or metrics, of the named runs, of all runs without names."""
    rows = spark.read.schema(_RUN_METRICS if metrics else _RECORD).parquet(path)
    return rows.where(F.col("run_id").isin(*run_ids)) if run_ids else rows


def diff_runs(spark: SparkSession, records: str, metrics: str, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Differences of parameters and of metrics between two stored runs."""

    def of(path: str, run: str, is_metrics: bool) -> DataFrame:
        return read_runs(spark, path, run, metrics=is_metrics).drop("run_id")

    params = params_diff(of(records, a, False), of(records, b, False))
    return params, metrics_diff(of(metrics, a, True), of(metrics, b, True), ("model",))


_BASELINE = "metric string, value double"
_POINTER = "version bigint, folder string"


def _current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Version and folder of the newest promotion; 0 before the first."""
    try:
        newest = spark.read.schema(_POINTER).json(f"{path}/pointer").agg(F.max(F.struct("version", "folder")).alias("p")).first()["p"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    return (newest["version"], newest["folder"]) if newest else (0, None)


def _commit(spark: SparkSession, path: str, version: int, folder: str) -> bool:
    """Make a folder the given version; False if another job was first.

    The pointer is written beside its place and renamed to it, which the file system does at once
    and only if nothing is there.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    own, target = hadoop.Path(f"{path}/pointer/_{folder}"), hadoop.Path(f"{path}/pointer/{version:020d}.json")
    files = target.getFileSystem(conf)
    own, target = files.makeQualified(own), files.makeQualified(target)
    files.mkdirs(target.getParent())
    out = files.create(own, True)
    out.write(json.dumps({"version": version, "folder": folder}).encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(target.toUri(), conf).rename(own, target, options)
    except Py4JJavaError as error:
        files.delete(own, False)
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest promoted version, or None before the first promotion."""
    folder = _current(spark, path)[1]
    return None if folder is None else spark.read.schema(_BASELINE).parquet(f"{path}/metrics/folder={folder}")


def read_promotions(spark: SparkSession, path: str) -> DataFrame:
    """Every promoted version with its metrics: (version, metric, value)."""
    pointer = spark.read.schema(_POINTER).json(f"{path}/pointer")
    stored = spark.read.schema(f"{_BASELINE}, folder string").parquet(f"{path}/metrics")
    return lookup_join(stored, pointer, ["folder"]).select("version", "metric", "value")


def gate_and_promote(spark: SparkSession, new: DataFrame, path: str) -> bool:
    """Judge new (metric, value) rows against the stored baseline and store them if they pass.

    Metrics go to a folder of their own, which becomes the next version only if the version they
    were judged against is still the newest; else they are judged again. So of jobs that run at the
    same time each is judged against the one before it, and a job that fails changes nothing.
    """
    new = materialise(new.select("metric", "value"))
    folder = None
    while True:
        version, current = _current(spark, path)
        baseline = None if current is None else spark.read.schema(_BASELINE).parquet(f"{path}/metrics/folder={current}")
        verdict = gate_verdict(regression_gate(new, baseline))
        if not verdict.first()["passed"]:
            return False
        if folder is None:
            folder = uuid.uuid4().hex
            promote_baseline(new, baseline, verdict).select("metric", "value").write.parquet(f"{path}/metrics/folder={folder}")
        if _commit(spark, path, version + 1, folder):
            return True
