"""One query per operator over the whole of the driver's tables.

Arrays are returned as joined text so that any client can compare them.
"""

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.tables import Tables, spread
from pairloom import schemas as s
from pairloom.functions import cleaning
from pairloom.functions.text import space_pieces
from pairloom.operators import curate, encoding, examples, feedback, gate, results, scoring, split
from pairloom.operators.joins import lookup_join
from pairloom.plans import feedback as feedback_plan
from pairloom.plans.evaluation import score_generations
from pairloom.sources import csv_format, evalset, pairs as pair_files
from pairloom.sources import feedback as feedback_files
from pairloom.sources import results as result_files
from pairloom.storage import materialise, scratch_path
from pairloom.streaming import feedback as streams

FIRST = 500
PER_TASK = 50
VOCAB = 20_000
RUN_KEYS = ("run_id", "sample_id")


def joined(col: str) -> Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ").alias(col)


# Sources and sinks


def union_splits(t: Tables) -> DataFrame:
    pairs = t.pairs()
    by_split = {name: pairs.where(F.col("split") == name).drop("split") for name in s.SPLIT_ORDER}
    return curate.union_splits(by_split, "ex_id")


def project_pairs(t: Tables) -> DataFrame:
    pairs = t.pairs()
    parts = []
    for task, (prompt, answer) in s.PAIR_COLUMNS.items():
        raw = pairs.where(F.col("task") == task).select(
            "ex_id", F.col("prompt").alias(prompt), F.col("answer").alias(answer)
        )
        parts.append(curate.project_pairs(raw, task))
    return parts[0].unionByName(parts[1])


def pairs_csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "pairs-csv")
    odd = F.col("ex_id") % 2 == 1
    # Two orders of columns: readers go by the header.
    for part, columns in ((t.pairs().where(~odd), s.PAIRS.names), (t.pairs().where(odd), s.PAIRS.names[::-1])):
        pair_files.write_pairs_csv(part.select(*columns), f"{path}/{columns[0]}")
    return pair_files.read_pairs_csv(t.spark, f"{path}/*")


def examples_parquet_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "examples")
    pair_files.write_examples(split.exact_split(_examples(t)), path)
    stored = pair_files.read_examples(t.spark, path)
    return stored.select("ex_id", "task", "part", *map(joined, ("input_ids", "attention_mask", "labels")))


def _eval_set(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "eval-set")
    t.eval_documents().select("value").write.option("maxRecordsPerFile", 1).text(path)
    return evalset.load_eval_set(t.spark, path)


def load_eval_set(t: Tables) -> DataFrame:
    loaded = _eval_set(t)
    return loaded.select(
        "id",
        "task",
        "prompt",
        "function_name",
        "reference_code",
        F.coalesce(F.array_size("test_cases"), F.lit(0)).alias("n_cases"),
        "code",
        "reference_docstring",
    )


def explode_test_cases(t: Tables) -> DataFrame:
    return evalset.explode_test_cases(_eval_set(t))


def _feedback_files(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "feedback-csv")
    raw = t.feedback_raw().withColumnRenamed("rating_raw", "rating")
    other = F.pmod(F.crc32(F.col("file").cast("binary")), F.lit(2)) == 1
    feedback_files.write_feedback_csv(raw.where(~other), path)
    # Other files have another order of columns and one more: readers go by the header.
    turned = raw.where(other).select("file", "rating", "event_id", *s.FEEDBACK_RAW.names[:-1])
    turned.write.mode("append").options(**csv_format.WRITE).partitionBy("file").csv(path)
    return feedback_files.load_feedback_csv(t.spark, path, partitioned=True).drop("pos")


def load_feedback_csv(t: Tables) -> DataFrame:
    return _feedback_files(t)


def feedback_json_sink(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "feedback-json")
    rows = materialise(_parsed_feedback(t).drop("file", "event_id", "ts"))
    feedback_files.feedback_json_sink(rows, feedback.feedback_pairs(rows), path)
    stored = t.spark.read.schema(
        "timestamp string, task string, prompt string, response string, rating bigint"
    ).json(f"{path}/all_feedback")
    pairs = t.spark.read.schema("task string, text string").json(f"{path}/training_pairs")
    none = F.lit(None).cast("string")
    return stored.select(
        F.lit("all_feedback").alias("output"), "timestamp", "task", "prompt", "response", "rating", none.alias("text")
    ).unionByName(pairs.select(F.lit("training_pairs").alias("output"), "task", "text"), allowMissingColumns=True)


def results_json_sink(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "results-json")
    records = materialise(_filled(t, texts=True))
    samples = t.run_samples()
    metrics = results.compute_metrics(records)
    result_files.results_json_sink(
        results.assemble_results(samples, records, RUN_KEYS),
        metrics,
        result_files.run_config(t.spark, "base-model", ["task_1", "task_2"], None, samples),
        path,
    )
    config = t.spark.read.schema(
        "base_model string, adapters array<string>, judge_model string, num_samples bigint"
    ).json(f"{path}/config")
    stored = t.spark.read.schema(metrics.schema).json(f"{path}/metrics")
    record = "struct<bleu: double, raw_response: string>"
    rows = t.spark.read.schema(
        ", ".join(["run_id bigint, sample_id bigint", *[f"{m} {record}" for m in s.MODELS]])
    ).json(f"{path}/results")
    none = F.lit(None)

    def entry(key: str, value: Column, text: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.cast("double").alias("value"), text.cast("string").alias("text"))

    facts = config.select(
        F.inline(
            F.array(
                entry("num_samples", F.col("num_samples"), none),
                entry("base_model", none, F.col("base_model")),
                entry("adapters", none, F.array_join("adapters", ",")),
                entry("judge_model", none, F.col("judge_model")),
            )
        )
    )
    # Every stored record, in one read of the results.
    by_model = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"{m}.bleu").alias("bleu"), F.col(f"{m}.raw_response").alias("text"), F.col(m).isNotNull().alias("there")) for m in s.MODELS]
    )
    records = rows.select("run_id", "sample_id", F.inline(by_model)).where("there")
    return (
        facts.select(F.lit("config").alias("part"), "key", "value", "text")
        .unionByName(
            results.long_metrics(stored).select(
                F.lit("metrics").alias("part"), F.concat_ws(".", "model", "metric").alias("key"), "value", none.cast("string").alias("text")
            )
        )
        .unionByName(
            records.select(
                F.lit("results").alias("part"), F.concat_ws(".", "run_id", "sample_id", "model").alias("key"), F.col("bleu").alias("value"), "text"
            )
        )
    )


# Filters and limits


def _document_pairs(t: Tables) -> DataFrame:
    digit = F.col("doc_id") % 10
    return t.documents("doc_id", "text", "source").select(
        F.col("doc_id").alias("ord"),
        F.when(digit == 0, 2).when(digit == 1, 1).otherwise(0).alias("split_rank"),
        F.col("text").alias("prompt"),
        F.col("source").alias("answer"),
    )


def length_filter(t: Tables) -> DataFrame:
    pieces = space_pieces(F.col("prompt")) + space_pieces(F.col("answer"))
    return curate.length_filter(_document_pairs(t)).select("ord", "answer", pieces.alias("pieces"))


def first_n(t: Tables) -> DataFrame:
    short = curate.length_filter(_document_pairs(t))
    return curate.first_n(short, FIRST).select("split_rank", "ord", "prompt")


def sample_per_task(t: Tables) -> DataFrame:
    rows = t.generations().select("gen_id", "task", "model")
    return curate.sample_per_task(rows, PER_TASK, ("gen_id",))


def truncate_tokens(t: Tables) -> DataFrame:
    ids = _document_ids(t).withColumn(
        "attention_mask", F.transform("input_ids", lambda x: F.lit(1))
    )
    cut = examples.truncate_tokens(ids, s.APP_TOKEN_LIMIT)
    longer = examples.truncate_tokens(ids, s.EVAL_TOKEN_LIMIT).select("doc_id", F.size("attention_mask").alias("n_eval"))
    shown = cut.select("doc_id", *map(joined, ("input_ids", "attention_mask")))
    return shown.join(longer, "doc_id")


def truncate_response(t: Tables) -> DataFrame:
    cut = cleaning.truncate_response(F.col("text"), s.RESPONSE_LIMIT)
    return t.documents("doc_id", "text").select("doc_id", cut.alias("raw_response"))


# Examples


def format_prompt(t: Tables) -> DataFrame:
    pairs = t.pairs().withColumn(
        "task", F.when(F.col("ex_id") % 7 == 0, "other").otherwise(F.col("task"))
    )
    padded = pairs.withColumn("prompt", F.concat(F.lit(" \t"), "prompt", F.lit("\n")))
    plain = examples.format_prompt(padded)
    both = examples.format_prompt(plain, strip=True, out="app_input")
    return both.select("ex_id", "task", "model_input", "app_input")


def _document_vocab(t: Tables) -> DataFrame:
    return examples.build_vocab(t.documents("text"), ("text",), VOCAB)


def build_vocab(t: Tables) -> DataFrame:
    return _document_vocab(t)


def _document_ids(t: Tables) -> DataFrame:
    docs = t.documents("doc_id", "text")
    vocab = materialise(_document_vocab(t))
    return examples.encode_tokens(docs, vocab, {"text": "input_ids"}).drop("text")


def encode_tokens(t: Tables) -> DataFrame:
    ids = _document_ids(t)
    return ids.select(
        "doc_id",
        F.size("input_ids").alias("n_tokens"),
        F.size(F.filter("input_ids", lambda x: x == s.UNK_ID)).alias("n_unknown"),
        joined("input_ids"),
    )


def encode_lossless(t: Tables) -> DataFrame:
    """Every document through a stored byte-level tokeniser and back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = encoding.encode_with(t.documents("doc_id", "text"), path, {"text": "ids"}).drop("text")
    back = encoding.decode_with(ids, path, {"ids": "text"})
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _examples(t: Tables) -> DataFrame:
    texts = examples.format_prompt(spread(t.pairs())).drop("split")
    vocab = materialise(examples.build_vocab(texts, ("model_input", "answer"), VOCAB))
    encoded = examples.encode_tokens(texts, vocab, {"model_input": "prompt_ids", "answer": "answer_ids"})
    return examples.assemble_examples(encoded)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("ex_id", "task", *map(joined, ("input_ids", "attention_mask", "labels")))


def assemble_examples(t: Tables) -> DataFrame:
    return _shown(_examples(t))


def max_length(t: Tables) -> DataFrame:
    return examples.max_length(_examples(t))


def pad_right(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "unpadded")
    _examples(t).write.parquet(path)
    return _shown(examples.pad_right(t.spark.read.parquet(path)))


# Splitting


def exact_split(t: Tables) -> DataFrame:
    events = t.table("events").select("event_id", "event_type")
    return split.exact_split(events, key="event_id", group="event_type")


def split_counts(t: Tables) -> DataFrame:
    pairs = t.pairs().select("ex_id", "task", "split")
    return split.split_counts(split.exact_split(pairs), ("task", "split", "part"))


# Cleaning and scoring


def chat_prompts(t: Tables) -> DataFrame:
    return scoring.chat_prompts(t.generations(), "raw_response").select("gen_id", "chat_prompt")


def judge_prompts(t: Tables) -> DataFrame:
    refs = t.references()
    gens = lookup_join(t.generations(), refs, ["sample_id"])
    filled = scoring.judge_prompts(gens.withColumn("prompt", F.col("model")), generated_col="raw_response")
    return filled.select("gen_id", "judge_prompt")


def extract_function(t: Tables) -> DataFrame:
    return t.raw_responses().select("doc_id", cleaning.extract_function("raw").alias("generated"))


def clean_docstring(t: Tables) -> DataFrame:
    return t.raw_responses().select("doc_id", cleaning.clean_docstring(F.col("raw")).alias("generated"))


def function_name(t: Tables) -> DataFrame:
    return t.raw_responses().select(
        "doc_id", cleaning.function_name(F.col("raw"), F.col("doc_id")).alias("function")
    )


def tokenize_text(t: Tables) -> DataFrame:
    toks = scoring.tokenize_text(t.documents("doc_id", "text"), "text")
    return toks.select("doc_id", F.size("tokens").alias("n_tokens"), joined("tokens"))


def ngram_counts(t: Tables) -> DataFrame:
    toks = scoring.tokenize_text(t.documents("doc_id", "text"), "text")
    grams = scoring.ngram_counts(toks, "doc_id", "tokens")
    return grams.groupBy("doc_id", "n").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("cnt").alias("n_total"),
        F.max("cnt").alias("max_cnt"),
        F.sum(F.col("cnt") * F.length("gram")).alias("weighted_length"),
        F.sum(F.col("cnt") * F.col("cnt")).alias("squared_cnt"),
        F.sum(F.ascii("gram") * F.col("cnt")).alias("weighted_first"),
    )


def bleu(t: Tables) -> DataFrame:
    hyps = t.generations().select("gen_id", "sample_id", "raw_response")
    scored = scoring.bleu(hyps, t.references(), ["sample_id"], hyp_col="raw_response")
    return scored.select("gen_id", "sample_id", "bleu")


def parse_judge_score(t: Tables) -> DataFrame:
    score = cleaning.parse_judge_score(F.col("judge_response"))
    return t.generations().select("gen_id", "judge_response", score.alias("quality_score"))


def test_pass_rate(t: Tables) -> DataFrame:
    every = results.with_models(t.run_samples().select(*RUN_KEYS))
    return scoring.test_pass_rate(every, t.outcomes(), [*RUN_KEYS, "model"])


# Joins and aggregates over scored generations


def _records(t: Tables, texts: bool) -> DataFrame:
    scored = score_generations(t.generations(), t.references(), t.outcomes(), RUN_KEYS)
    if not texts:
        scored = scored.drop("generated", "raw_response")
    # Same keys as the joins before and after, so the rows stay where they are.
    return scored.join(t.telemetry(), [*RUN_KEYS, "model"], "left").drop("gen_id", "task")


def _filled(t: Tables, texts: bool = False) -> DataFrame:
    return results.fill_skipped(t.run_samples(), _records(t, texts), RUN_KEYS)


def fill_skipped(t: Tables) -> DataFrame:
    return _filled(t, texts=True).select(
        *RUN_KEYS,
        "model",
        "task",
        "generated",
        "test_passed",
        "test_total",
        "pass_rate",
        "bleu",
        "quality_score",
        "latency_ms",
        "memory_mb",
        "raw_response",
    )


def assemble_results(t: Tables) -> DataFrame:
    nested = results.assemble_results(t.run_samples(), _filled(t, texts=True), RUN_KEYS)
    fields = ("bleu", "pass_rate", "quality_score", "generated")
    flat = [F.col(f"{m}.{f}").alias(f"{m}_{f}") for m in s.MODELS for f in fields]
    return nested.select(*RUN_KEYS, "task", "function_name", "code", *flat)


def _run_metrics(t: Tables) -> DataFrame:
    """(run_id, model, metric, value) of every run."""
    by = ("run_id", "model")
    return materialise(results.long_metrics(results.compute_metrics(_filled(t), by), by))


def _as_baseline(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("run_id", F.col("run_id") + 1)


def _gate(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    new = _run_metrics(t)
    old = _as_baseline(new)
    return new, old, gate.regression_gate(new, old, by=("run_id", "model"))


def regression_gate(t: Tables) -> DataFrame:
    """Every run against the run before it."""
    judged = _gate(t)[2]
    verdict = gate.gate_verdict(judged, ("run_id", "model"))
    return judged.join(verdict, ["run_id", "model"])


def promote_baseline(t: Tables) -> DataFrame:
    new, old, judged = _gate(t)
    by = ("run_id", "model")
    return gate.promote_baseline(new, old, gate.gate_verdict(judged, by), by)


def baseline_store(t: Tables) -> DataFrame:
    """The metrics of every model in turn, judged against the store and promoted if they pass: what the store then holds."""
    path = scratch_path(t.spark, "baseline")
    stored = _results_document(t)
    for model in s.MODELS:
        new = stored.where(F.col("model") == model).select("metric", "value")
        result_files.gate_and_promote(t.spark, new, path)
    return result_files.read_promotions(t.spark, path)


def _results_document(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "results-document")
    records = materialise(_filled(t))
    result_files.results_json_sink(
        results.assemble_results(t.run_samples(), records, RUN_KEYS),
        results.compute_metrics(records),
        result_files.run_config(t.spark, "base-model", ["task_1"], None, t.run_samples()),
        path,
        models=(),
    )
    return result_files.read_results(t.spark, path)


def read_results(t: Tables) -> DataFrame:
    return _results_document(t)


def run_store(t: Tables) -> DataFrame:
    """The metrics of all runs as the store has them after they were put there twice."""
    path = scratch_path(t.spark, "runs")
    metrics = _run_metrics(t)
    for _ in range(2):
        result_files.append_run_metrics(metrics, path)
    return result_files.read_runs(t.spark, path, metrics=True).select(F.col("run_id").cast("long"), "model", "metric", "value")


def params_diff(t: Tables) -> DataFrame:
    """The parameters of every day against those of the day before."""
    params = t.daily_params()
    return gate.params_diff(params.withColumn("run_id", F.col("run_id") + 1), params, ("run_id",))


def metrics_diff(t: Tables) -> DataFrame:
    new = _run_metrics(t)
    return gate.metrics_diff(_as_baseline(new), new, ("run_id", "model"))


def compute_metrics(t: Tables) -> DataFrame:
    return results.compute_metrics(_filled(t))


def metrics_table(t: Tables) -> DataFrame:
    return results.metrics_table(results.compute_metrics(_filled(t)))


def per_sample_report(t: Tables) -> DataFrame:
    report = results.per_sample_report(_filled(t), RUN_KEYS)
    return report.orderBy("run_id", "sample_id")


def run_record(t: Tables) -> DataFrame:
    counts = split.split_counts(split.exact_split(t.pairs().select("ex_id", "task")))
    params = t.spark.createDataFrame(
        [
            ("training.base_model", "base-model"),
            ("training.task_1_target_modules", "att_q,att_o"),
            ("training.task_2_target_modules", "mlp_up,mlp_down"),
            ("training.lora_r", "4"),
            ("training.lora_dropout", "0.1"),
            ("data.task_1_split", "0.8"),
        ],
        "key string, value string",
    )
    return gate.run_record(params, counts, "run-1", {"git_hash": "abc1234"})


# Feedback


def _parsed_feedback(t: Tables) -> DataFrame:
    return feedback.parse_feedback(t.feedback_raw())


def parse_feedback(t: Tables) -> DataFrame:
    return _parsed_feedback(t).select("event_id", "file", "task", "prompt", "response", "rating")


def feedback_summary(t: Tables) -> DataFrame:
    return feedback.feedback_summary(_parsed_feedback(t))


def feedback_pairs(t: Tables) -> DataFrame:
    return feedback.feedback_pairs(_parsed_feedback(t))


def feedback_append_stream(t: Tables) -> DataFrame:
    out, state = scratch_path(t.spark, "ratings"), scratch_path(t.spark, "ratings-state")
    schema = t.table("events").schema
    events = streams.read_feedback_stream(t.spark, t.sf_dir, "parquet", schema, name_glob="events.parquet")
    ratings = events.select(
        "event_id", "ts", F.col("event_type").alias("prompt"), F.when(F.col("value") < 40, 1).otherwise(0).alias("rating")
    )
    streams.feedback_append_stream(ratings, out, state, ts_col="ts").awaitTermination()
    return t.spark.read.parquet(out).select("event_id", F.col("day").cast("string").alias("day"), "prompt", "rating")


def feedback_daily_counts(t: Tables) -> DataFrame:
    counts = feedback.feedback_daily_counts(_parsed_feedback(t))
    return counts.withColumn("day", F.col("day").cast("string"))


def _halves(t: Tables) -> list[DataFrame]:
    """Raw feedback in two parts, by file."""
    raw = t.feedback_raw().withColumnRenamed("rating_raw", "rating")
    late = F.pmod(F.crc32(F.col("file").cast("binary")), F.lit(2)) == 1
    return [raw.where(~late), raw.where(late)]


def feedback_incremental(t: Tables) -> DataFrame:
    """What two runs keep and reject, the second of which has only the newer files to read."""
    folder, out, state = (scratch_path(t.spark, n) for n in ("daily", "collected", "collected-state"))
    for part in _halves(t):
        feedback_files.write_feedback_csv(part, folder)
        feedback_plan.collect_new_feedback(t.spark, folder, out, state, partitioned=True)
    texts = "file string, timestamp string, task string, prompt string, response string"
    kept = t.spark.read.schema(f"{texts}, rating bigint").json(f"{out}/all_feedback")
    bad = t.spark.read.schema(f"{texts}, reason string").json(f"{out}/rejected")
    return kept.unionByName(bad, allowMissingColumns=True).drop("batch")


def feedback_daily_stream(t: Tables) -> DataFrame:
    """Counts that a stream kept over a stop between two parts of the ratings."""
    folder, out, state = (scratch_path(t.spark, n) for n in ("ratings-in", "daily-counts", "daily-state"))
    for part in _halves(t):
        rows = feedback.parse_feedback(part, "rating").select("ts", "task")
        rows.write.mode("append").parquet(folder)
        stream = streams.read_feedback_stream(t.spark, folder, "parquet", rows.schema, files_per_trigger=64)
        streams.keep_daily_counts(stream, out, state).awaitTermination()
    return streams.read_daily_counts(t.spark, out).withColumn("day", F.col("day").cast("string"))


def _bind(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(Tables(spark, sf_dir))

    return run


ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _bind(f)
    for f in (
        union_splits, project_pairs, pairs_csv_roundtrip, examples_parquet_roundtrip, load_eval_set,
        explode_test_cases, load_feedback_csv, feedback_json_sink, results_json_sink, length_filter,
        first_n, sample_per_task, truncate_tokens, truncate_response, format_prompt, build_vocab,
        encode_tokens, encode_lossless, assemble_examples, max_length, pad_right, exact_split, split_counts,
        chat_prompts, judge_prompts, extract_function, clean_docstring, tokenize_text, ngram_counts,
        bleu, parse_judge_score, test_pass_rate, function_name, fill_skipped, assemble_results,
        regression_gate, params_diff, metrics_diff, compute_metrics, metrics_table,
        per_sample_report, promote_baseline, run_record, parse_feedback, feedback_summary,
        feedback_pairs, feedback_append_stream, feedback_daily_counts, feedback_incremental,
        feedback_daily_stream, read_results, baseline_store, run_store,
    )
}
