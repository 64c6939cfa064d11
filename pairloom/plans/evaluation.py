"""From generations and test outcomes to metrics and the gate."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.cleaning import parse_judge_score
from pairloom.operators.results import compute_metrics, fill_skipped
from pairloom.operators.scoring import bleu, clean_output, test_pass_rate
from pairloom.schemas import MODELS


def score_generations(
    generations: DataFrame,
    references: DataFrame,
    outcomes: DataFrame,
    keys: tuple[str, ...] = ("sample_id",),
) -> DataFrame:
    """Result records: cleaned text, BLEU, pass rate, judge score, latency and memory.

    ``generations`` has one row per (*keys, model); ``references`` one per sample_id. Texts are
    scored where they are read; later joins move them only if the caller keeps them.
    """
    cleaned = clean_output(generations)
    scored = bleu(cleaned, references, ["sample_id"], hyp_col="generated")
    measures = {c: F.round(c, 1) for c in ("latency_ms", "memory_mb") if c in scored.columns}
    rated = scored.withColumns(
        {"quality_score": parse_judge_score(F.col("judge_response")), **measures}
    ).drop("judge_response")
    return test_pass_rate(rated, outcomes, [*keys, "model"])


def evaluate(
    samples: DataFrame,
    generations: DataFrame,
    references: DataFrame,
    outcomes: DataFrame,
    keys: tuple[str, ...] = ("sample_id",),
    models: tuple[str, ...] = MODELS,
    by: tuple[str, ...] = ("model",),
) -> DataFrame:
    """Metrics per model, with skipped samples counted as zeros."""
    results = score_generations(generations, references, outcomes, keys)
    return compute_metrics(fill_skipped(samples, results, keys, models), by)
