"""Result records, metrics and reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.cleaning import function_name
from pairloom.schemas import CODE_TASK, DOC_TASK, METRICS, MODELS, SKIPPED_NO_KEY

# Field names and contents of a record that was never produced.
_EMPTY_RECORD = {
    "generated": "",
    "test_passed": 0,
    "test_total": 0,
    "pass_rate": 0.0,
    "bleu": 0.0,
    "quality_score": 0,
    "latency_ms": 0.0,
    "memory_mb": 0.0,
}


def with_models(samples: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Every sample once per model."""
    return samples.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def fill_skipped(
    samples: DataFrame,
    results: DataFrame,
    keys: tuple[str, ...] = ("sample_id",),
    models: tuple[str, ...] = MODELS,
    reason: str = SKIPPED_NO_KEY,
) -> DataFrame:
    """A record for every sample and model; absent ones hold empty values and the reason.

    A record that exists keeps its nulls, such as the score of a generation without a reference.
    """
    on = [*keys, "model"]
    extra = [c for c in results.columns if c not in on and c not in samples.columns]
    filled = with_models(samples, models).join(
        results.select(*on, *extra, F.lit(True).alias("_made")), on, "left"
    )
    values = {c: v for c, v in _EMPTY_RECORD.items() if c in extra}
    if "raw_response" in extra:
        values["raw_response"] = reason
    absent = F.col("_made").isNull()
    return filled.withColumns(
        {c: F.when(absent, F.lit(v).cast(filled.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    ).drop("_made")


def assemble_results(
    samples: DataFrame,
    results: DataFrame,
    keys: tuple[str, ...] = ("sample_id",),
    models: tuple[str, ...] = MODELS,
) -> DataFrame:
    """One row per sample with a nested record per model, null where there is none.

    ``results`` has one row per key and model.
    """
    meta = ("task", "function_name", "code")
    fields = [c for c in results.columns if c not in keys and c != "model" and c not in meta]
    record = F.struct(*fields)
    nested = results.groupBy(*keys).agg(
        *[F.first(F.when(F.col("model") == m, record), ignorenulls=True).alias(m) for m in models]
    )
    return samples.join(nested, list(keys), "left").select(
        *keys,
        "task",
        F.coalesce("function_name", F.lit("")).alias("function_name"),
        F.coalesce("code", F.lit("")).alias("code"),
        *models,
    )


def _mean(value: str, keep: Column) -> Column:
    """Mean of known values to 4 places, 0 for none. Summed as decimals, so the row order cannot matter."""
    keep = keep & F.col(value).isNotNull()
    exact = F.sum(F.when(keep, F.col(value).cast("decimal(24,4)"))).cast("double")
    return F.round(F.coalesce(F.try_divide(exact, F.count_if(keep)), F.lit(0.0)), 4)


def compute_metrics(results: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Seven metrics per model: macro means of per-sample values; memory only where it was measured."""
    code, doc = F.col("task") == CODE_TASK, F.col("task") == DOC_TASK
    both = code | doc
    columns = (
        _mean("pass_rate", code),
        _mean("bleu", code),
        _mean("quality_score", code),
        _mean("bleu", doc),
        _mean("quality_score", doc),
        F.round(_mean("latency_ms", both), 1),
        F.round(_mean("memory_mb", both & (F.col("memory_mb") > 0)), 1),
    )
    return results.groupBy(*by).agg(*[c.alias(m) for c, m in zip(columns, METRICS)])


def long_metrics(metrics: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """One row per metric."""
    names = [c for c in metrics.columns if c not in by]
    return metrics.unpivot(list(by), [f"`{c}`" for c in names], "metric", "value")


def metrics_table(
    metrics: DataFrame, models: tuple[str, ...] = MODELS, by: tuple[str, ...] = ()
) -> DataFrame:
    """Metrics as rows, models as columns."""
    long = long_metrics(metrics, (*by, "model"))
    return long.groupBy(*by, "metric").pivot("model", list(models)).agg(F.first("value"))


def _by_model(df: DataFrame, keys: list[str], text: Column, models: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, text)).alias(m) for m in models])


def per_sample_report(
    results: DataFrame, keys: tuple[str, ...] = ("sample_id",), models: tuple[str, ...] = MODELS
) -> DataFrame:
    """Printable lines: passed/total (rate) for code samples, BLEU for docstring samples."""
    percent = F.bround(F.col("pass_rate") * 100, 0).cast("bigint").cast("string")
    code_text = F.concat(
        F.col("test_passed").cast("string"),
        F.lit("/"),
        F.col("test_total").cast("string"),
        F.lit(" ("),
        percent,
        F.lit("%)"),
    )
    doc_text = F.format_string("%.4f", F.col("bleu"))
    named = results.where(F.col("task").isin(CODE_TASK, DOC_TASK)).withColumn(
        "function",
        F.when(F.col("task") == CODE_TASK, F.coalesce("function_name", F.lit(""))).otherwise(
            function_name(F.col("code"), F.col("sample_id"))
        ),
    )
    text = F.when(F.col("task") == CODE_TASK, code_text).otherwise(doc_text)
    return _by_model(named, [*keys, "task", "function"], text, models)
