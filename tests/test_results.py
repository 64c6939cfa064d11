from conftest import rows
from pyspark.sql import functions as F

from pairloom.operators import gate, results
from pairloom.schemas import METRICS

RESULTS = "sample_id int, model string, test_passed bigint, test_total bigint, pass_rate double, bleu double, quality_score int, latency_ms double, memory_mb double, raw_response string"


def tables(spark):
    samples = spark.createDataFrame(
        [(1, "code_generation", "f", None), (2, "code_generation", None, None), (3, "docstring_generation", None, "def g(x): 1")],
        "sample_id int, task string, function_name string, code string",
    )
    records = spark.createDataFrame(
        [
            (1, "candidate", 2, 3, 0.6667, 0.5, 4, 10.0, 0.0, "r1"),
            (2, "candidate", 1, 1, 1.0, 0.25, 5, 20.0, 100.0, "r2"),
            (3, "candidate", 0, 0, 0.0, 0.1234, 3, 30.25, 50.0, "r3"),
            (1, "base", 1, 8, 0.125, 0.0, 0, 5.0, 0.0, "r4"),
        ],
        RESULTS,
    )
    return samples, records


def test_skipped_models_count_as_zeros(spark):
    samples, records = tables(spark)
    filled = results.fill_skipped(samples, records)
    assert filled.count() == 9
    skipped = filled.where("model = 'cloud' and sample_id = 1").first()
    assert (skipped.bleu, skipped.test_total, skipped.raw_response) == (0.0, 0, "SKIPPED (no API key)")
    m = {r.model: r for r in results.compute_metrics(filled).collect()}
    c = m["candidate"]
    assert [c[x] for x in METRICS] == [0.8334, 0.375, 4.5, 0.1234, 3.0, 20.1, 75.0]
    assert [m["cloud"][x] for x in METRICS] == [0.0] * 7
    assert [m["base"][x] for x in METRICS] == [0.0625, 0.0, 0.0, 0.0, 0.0, 1.7, 0.0]


def test_metrics_do_not_depend_on_layout(spark):
    samples, records = tables(spark)
    filled = results.fill_skipped(samples, records)
    want = rows(results.compute_metrics(filled.repartition(1)))
    assert rows(results.compute_metrics(filled.repartition(7))) == want


def test_metrics_table(spark):
    samples, records = tables(spark)
    table = results.metrics_table(results.compute_metrics(results.fill_skipped(samples, records)))
    assert table.columns == ["metric", "candidate", "base", "cloud"]
    assert {r.metric: r.candidate for r in table.collect()}["codegen_quality (1-5)"] == 4.5


def test_report_lines(spark):
    samples, records = tables(spark)
    report = results.per_sample_report(results.fill_skipped(samples, records))
    assert rows(report) == [
        (1, "code_generation", "f", "2/3 (67%)", "1/8 (12%)", "0/0 (0%)"),
        (2, "code_generation", "", "1/1 (100%)", "0/0 (0%)", "0/0 (0%)"),
        (3, "docstring_generation", "g", "0.1234", "0.0000", "0.0000"),
    ]


def test_assembled_results(spark):
    samples, records = tables(spark)
    nested = {r.sample_id: r for r in results.assemble_results(samples, records).collect()}
    assert nested[1].candidate.bleu == 0.5 and nested[1].base.raw_response == "r4" and nested[1].cloud is None
    assert (nested[2].function_name, nested[2].code) == ("", "")


def test_samples_without_records_and_scores_without_references(spark):
    samples, records = tables(spark)
    extra = samples.limit(1).withColumn("sample_id", F.lit(77))
    nested = {r.sample_id: r for r in results.assemble_results(samples.unionByName(extra), records).collect()}
    assert nested[77].candidate is None and nested[77].base is None
    unknown = records.withColumn("bleu", F.when(F.col("bleu") != 0.5, F.col("bleu")))
    filled = results.fill_skipped(samples, unknown)
    assert filled.where("bleu is null").count() == records.where("bleu = 0.5").count() > 0


def metric_rows(spark, **kw):
    names = {"rate": "codegen_pass_rate", "quality": "codegen_quality (1-5)", "bleu": "docgen_bleu"}
    data = [(names[k], float(v)) for k, v in kw.items()]
    return spark.createDataFrame(data, "metric string, value double")


def judge(spark, new, old):
    out = gate.regression_gate(new, old)
    return {r.metric: r.status for r in out.collect()}, gate.gate_verdict(out).first().passed


def test_gate(spark):
    old = metric_rows(spark, rate=0.9, quality=3.0, bleu=0.5)
    assert judge(spark, metric_rows(spark, rate=0.881, quality=3.0, bleu=0.5), old)[1]
    status, passed = judge(spark, metric_rows(spark, rate=0.879, quality=3.0, bleu=0.5), old)
    assert status["codegen_pass_rate"] == "regression" and not passed
    # A collapse to zero and a missing metric are skipped.
    status, passed = judge(spark, metric_rows(spark, rate=0.0, bleu=0.6), old)
    assert passed and status["codegen_pass_rate"] == status["codegen_quality (1-5)"] == "skipped"
    assert judge(spark, metric_rows(spark, rate=0.1), None)[1]
    assert judge(spark, metric_rows(spark, rate=0.1), metric_rows(spark, bleu=1.0))[1]


def test_promotion(spark):
    old, new = metric_rows(spark, rate=0.9), metric_rows(spark, rate=0.95)
    for passed, want in ((True, 0.95), (False, 0.9)):
        verdict = spark.createDataFrame([(passed,)], "passed boolean")
        assert [r.value for r in gate.promote_baseline(new, old, verdict).collect()] == [want]


def test_diffs(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None), ("w", None)], "key string, value string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("n", "4"), ("w", None)], "key string, value string")
    assert rows(gate.params_diff(a, b)) == [
        ("n", None, "4", "added"),
        ("y", "2", "3", "changed"),
        ("z", None, None, "removed"),
    ]
    d = gate.metrics_diff(metric_rows(spark, rate=0.5, bleu=0.1), metric_rows(spark, rate=0.75, quality=3))
    assert rows(d) == [
        ("codegen_pass_rate", 0.5, 0.75, 0.25),
        ("codegen_quality (1-5)", None, 3.0, None),
        ("docgen_bleu", 0.1, None, None),
    ]


def test_run_record(spark):
    params = spark.createDataFrame(
        [("training.base_model", "m"), ("training.task_1_target_modules", "a,b"), ("training.lora_r", "4"), ("data.x", "1")],
        "key string, value string",
    )
    counts = spark.createDataFrame([("task_1", "train", 8), ("task_1", "validation", 2)], "task string, part string, n_rows bigint")
    measured = spark.createDataFrame([("task_1.train_loss", 0.25)], "key string, value double")
    assert rows(gate.run_record(params, counts, "r", {"timestamp": "2024-01-01T00:00:00"}, measured)) == [
        ("r", "base_model", "m"),
        ("r", "hyperparameters.lora_r", "4"),
        ("r", "task_1.eval_samples", "2"),
        ("r", "task_1.target_modules[0]", "a"),
        ("r", "task_1.target_modules[1]", "b"),
        ("r", "task_1.train_loss", "0.25"),
        ("r", "task_1.train_samples", "8"),
        ("r", "timestamp", "2024-01-01T00:00:00"),
    ]
