import json

import pytest

from conftest import rows
from pyspark.sql import functions as F

from pairloom.operators import feedback
from pairloom.plans.feedback import collect_feedback
from pairloom.schemas import PAIRS
from pairloom.sources import evalset, pairs, results
from pairloom.sources import feedback as files

PAIR_ROWS = [
    (1, "task_1", 'a\nb,"c"', "x\r\ny"),
    (2, "task_1", "", None),
    (3, "task_2", "NA", "back\\slash\\"),
    (4, "task_2", "  sp ", '"q"'),
    (5, "task_2", 'a\\"b', "\\"),
    (6, "task_1", "cr\ronly", " \ttab "),
    (7, "task_1", "é中\U0001f600", "#x"),
    (8, "task_1", None, "a,b"),
]


def test_pairs_survive_csv(spark, tmp_path):
    path = str(tmp_path / "pairs")
    pairs.write_pairs_csv(spark.createDataFrame(PAIR_ROWS, PAIRS), path, rows_per_file=2)
    assert rows(pairs.read_pairs_csv(spark, path)) == sorted(PAIR_ROWS, key=repr)


def test_pairs_written_elsewhere(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('text,code\n"say ""hi""\n",x\n"",NA\n', encoding="utf-8")
    got = pairs.read_pairs_csv(spark, str(path), "text string, code string")
    assert rows(got) == [("", "NA"), ('say "hi"\n', "x")]


def test_columns_go_by_the_header_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,text\nc1,t1\n")
    (tmp_path / "b.csv").write_text('\ufefftext,note,code\nt2,"n\n",c2\nt3,,c3\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("text,other\nt4,c4\n")
    (tmp_path / "d.csv").write_text("text,code,text\nold,c5,t5\n")
    (tmp_path / "e.csv").write_text("")
    got = pairs.read_pairs_csv(spark, str(tmp_path / "*.csv"), "text string, code string")
    assert rows(got) == [("t1", "c1"), ("t2", "c2"), ("t3", "c3"), ("t5", "c5")]
    assert pairs.read_pairs_csv(spark, str(tmp_path / "none*.csv")).columns == PAIRS.names
    only = pairs.read_pairs_csv(spark, str(tmp_path / "c.csv"), "text string, code string")
    assert only.count() == 0


def test_feedback_without_files_and_in_source_order(spark, tmp_path):
    assert files.load_feedback_csv(spark, str(tmp_path)).count() == 0
    head = "rating,extra,response,prompt,task,timestamp\n"
    (tmp_path / "feedback_2.csv").write_text(head + "".join(f"1,e,r,p{i},task_1,t\n" for i in range(20)))
    (tmp_path / "feedback_1.csv").write_text("timestamp,task,prompt,response,rating\nt,task_2,first,r,0\n")
    loaded = files.load_feedback_csv(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [r.prompt for r in loaded] == ["first", *[f"p{i}" for i in range(20)]]
    assert (loaded[1].timestamp, loaded[1].rating_raw) == ("t", "1")


def test_a_day_has_few_files(spark, tmp_path):
    df = spark.range(2000).repartition(16).select(
        F.concat(F.lit("feedback_"), (F.col("id") % 3).cast("string"), F.lit(".csv")).alias("file"),
        *[F.lit("x").alias(c) for c in ("timestamp", "task", "prompt", "response", "rating")],
    )
    files.write_feedback_csv(df, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*/part*"))) == 3
    assert files.load_feedback_csv(spark, str(tmp_path / "out"), partitioned=True).count() == 2000


def test_broken_evaluation_files_fail(spark, tmp_path):
    for i, text in enumerate(('[{"id": 1, "task": "x"}, {"id": 2', '[{"id": "one"}]')):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(Exception, match="MALFORMED|CANNOT_PARSE|FAILED_READ"):
            evalset.load_eval_set(spark, str(tmp_path / f"{i}.json")).collect()


def test_examples_are_pruned_by_folder(spark, tmp_path):
    path = str(tmp_path / "ex")
    df = spark.createDataFrame(
        [(1, "task_1", "train", [1], [1], [1]), (2, "task_2", "train", [2, 1], [1, 1], [-100, 1])],
        "ex_id bigint, task string, part string, input_ids array<int>, attention_mask array<int>, labels array<int>",
    )
    pairs.write_examples(df, path)
    got = pairs.read_examples(spark, path, "task_2", "train")
    assert [(r.ex_id, r.labels) for r in got.collect()] == [(2, [-100, 1])]
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(task" in scan


def test_eval_set(spark, tmp_path):
    samples = [
        {"id": 1, "task": "code_generation", "prompt": "p", "function_name": "f", "reference_code": "c",
         "test_cases": [{"input": [[1, 2], "x"], "expected": True}, {"input": [], "expected": "1010"},
                        {"input": [{"a": None}], "expected": None}, {"input": [1.5], "expected": [1, []]}]},
        {"id": 11, "task": "docstring_generation", "code": "d", "reference_docstring": "r"},
    ]
    (tmp_path / "array.json").write_text(json.dumps(samples, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, samples)))
    for name, lines in (("array.json", False), ("lines.json", True)):
        loaded = evalset.load_eval_set(spark, str(tmp_path / name), lines)
        assert rows(evalset.docstring_samples(loaded)) == [(11, "d", "r")]
        assert evalset.code_samples(loaded).count() == 1
        got = evalset.explode_test_cases(loaded).orderBy("case_idx").collect()
        assert [(r.id, r.case_idx) for r in got] == [(1, 0), (1, 1), (1, 2), (1, 3)]
        assert [json.loads(r.input) for r in got] == [c["input"] for c in samples[0]["test_cases"]]
        assert [json.loads(r.expected or "null") for r in got] == [True, "1010", None, [1, []]]


def feedback_folder(tmp_path):
    head = "timestamp,task,prompt,response,rating\n"
    (tmp_path / "feedback_2024-01-02.csv").write_text(
        head + 't3,task_2,"multi\nline","say ""x""",1\nt4,other,p,,0\nt5,task_1\n'
    )
    (tmp_path / "feedback_2024-01-01.csv").write_text(
        head + "t1,task_1,p1,r1,1\nt2,task_1,p2,r2, 1 \n" + "".join(f"x,task_1,p,r,{v}\n" for v in ("1.0", "", "abc", "+1", "1_0", "99999999999999999999"))
    )
    (tmp_path / "notes.csv").write_text(head + "t,task_1,p,r,1\n")
    (tmp_path / "feedback_x.txt").write_text("junk")
    return str(tmp_path)


def test_feedback_files(spark, tmp_path):
    loaded = files.load_feedback_csv(spark, feedback_folder(tmp_path))
    assert rows(loaded.groupBy("file").count()) == [("feedback_2024-01-01.csv", 8), ("feedback_2024-01-02.csv", 3)]
    parsed = feedback.parse_feedback(loaded)
    assert rows(parsed.where("timestamp != 'x'").select("timestamp", "prompt", "response", "rating")) == [
        ("t1", "p1", "r1", 1),
        ("t2", "p2", "r2", 1),
        ("t3", "multi\nline", 'say "x"', 1),
        ("t4", "p", "", 0),
    ]
    assert sorted(r.rating for r in parsed.where("timestamp = 'x'").collect()) == [1, 10, 2**63 - 1]
    assert rows(feedback.feedback_summary(parsed)) == [(7, 4, 3, 57, 43, 5, 2)]
    assert ("task_2", 'Generate docstring: multi\nline\nDocstring: say "x"') in rows(feedback.feedback_pairs(parsed))


def test_feedback_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = tmp_path / "out"
    summary = collect_feedback(spark, feedback_folder(tmp_path / "in"), str(out))
    assert summary.first().total == 7
    assert spark.read.json(str(out / "training_pairs")).count() == 4
    none = spark.createDataFrame([], "task string, text string")
    some = spark.createDataFrame([("a", "b")], "task string, text string")
    assert files.feedback_json_sink(some, none, str(tmp_path / "half")) == ["all_feedback"]
    assert not (tmp_path / "half" / "training_pairs").exists()
    assert feedback.feedback_summary(spark.createDataFrame([], "task string, rating bigint")).count() == 0


def test_baseline_store(spark, tmp_path):
    path = str(tmp_path / "baseline")

    def metrics(rate):
        return spark.createDataFrame([("codegen_pass_rate", rate)], "metric string, value double")

    assert results.read_baseline(spark, path) is None
    for rate, passed, stored in ((0.5, True, 0.5), (0.4, False, 0.5), (0.49, True, 0.49), (0.49, True, 0.49)):
        assert results.gate_and_promote(spark, metrics(rate), path) is passed
        assert results.read_baseline(spark, path).first().value == stored


def test_promotion_evaluates_once_and_passes_over_taken_versions(spark, tmp_path):
    path = str(tmp_path / "baseline")
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    new = spark.createDataFrame([("codegen_pass_rate", 0.5)], "metric string, value double")
    # A job that ended before its pointer was written.
    spark.createDataFrame([("codegen_pass_rate", 9.0)], "metric string, value double").write.parquet(f"{path}/metrics/version=1")
    assert results.gate_and_promote(spark, new.mapInArrow(seen, new.schema), path)
    assert calls.value == 1 and results.read_baseline(spark, path).first().value == 0.5
    assert spark.read.parquet(f"{path}/metrics/version=1").first().value == 9.0


def test_stored_runs_are_compared(spark, tmp_path):
    records, metrics = str(tmp_path / "records"), str(tmp_path / "metrics")
    for run, rank, rate in (("a", "4", 0.5), ("b", "8", 0.75)):
        results.append_run_record(spark.createDataFrame([(run, "lora_r", rank), (run, "same", "x")], "run_id string, key string, value string"), records)
        results.append_run_metrics(spark.createDataFrame([(run, "m", "bleu", rate)], "run_id string, model string, metric string, value double"), metrics)
    assert results.read_runs(spark, records).count() == 4 and results.read_runs(spark, records, "a").count() == 2
    params, scores = results.diff_runs(spark, records, metrics, "a", "b")
    assert rows(params) == [("lora_r", "4", "8", "changed")]
    assert rows(scores) == [("m", "bleu", 0.5, 0.75, 0.25)]


def test_run_records_are_appended(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run in ("a", "b"):
        results.append_run_record(spark.createDataFrame([(run, "k", "v")], "run_id string, key string, value string"), path)
    assert rows(spark.read.parquet(path).select("run_id")) == [("a",), ("b",)]


def test_results_document(spark, tmp_path):
    record = "struct<bleu: double, raw_response: string>"
    df = spark.createDataFrame(
        [(1, (0.5, "x" * 600), None), (2, (0.1, "y"), (0.2, None))], f"sample_id int, candidate {record}, base {record}"
    )
    metrics = spark.createDataFrame([("candidate", 0.5)], "model string, codegen_bleu double")
    config = results.run_config(spark, "m", ["task_1"], None, df)
    results.results_json_sink(df, metrics, config, str(tmp_path / "doc"), models=("candidate", "base"))
    read = spark.read.json(str(tmp_path / "doc" / "results")).orderBy("sample_id").collect()
    assert len(read[0].candidate.raw_response) == 503 and read[0].base is None
    assert (read[1].candidate.raw_response, read[1].base.raw_response) == ("y", "")
    assert json.loads(next((tmp_path / "doc" / "config").glob("part*")).read_text()) == {
        "base_model": "m", "adapters": ["task_1"], "judge_model": None, "num_samples": 2,
    }


def test_a_run_that_is_stored_twice_is_there_once(spark, tmp_path):
    records, metrics = str(tmp_path / "records"), str(tmp_path / "metrics")
    for run, value in (("a", "old"), ("b", "x"), ("a", "new"), ("a", "new")):
        results.append_run_record(spark.createDataFrame([(run, "k", value)], "run_id string, key string, value string"), records)
        results.append_run_metrics(spark.createDataFrame([(run, "m", "bleu", 0.5)], "run_id string, model string, metric string, value double"), metrics)
    assert rows(results.read_runs(spark, records).select("run_id", "value")) == [("a", "new"), ("b", "x")]
    assert results.read_runs(spark, metrics, metrics=True).count() == 2


def test_results_documents_are_read_into_the_gate(spark, tmp_path):
    def document(name, **values):
        path = tmp_path / name
        text = {"config": {"n": [1, {"a": 2}]}, "metrics": values, "results": [{"metrics": "no", "x": [1, 2]}, None]}
        path.write_text(json.dumps(text, indent=2))
        return str(path)

    old = document("old.json", tuned={"codegen_pass_rate": 0.9, "docgen_bleu": 0.1, "avg_latency_ms": 20}, plain={"docgen_bleu": 0.5})
    new = document("new.json", tuned={"codegen_pass_rate": 0.87, "docgen_bleu": 0.09, "codegen_quality (1-5)": 0, "x": None})
    assert rows(results.read_results(spark, new)) == [
        ("tuned", "codegen_pass_rate", 0.87), ("tuned", "codegen_quality (1-5)", 0.0), ("tuned", "docgen_bleu", 0.09),
    ]
    judged = rows(results.gate_documents(spark, new, old, "tuned").select("metric", "status"))
    assert judged == [("codegen_pass_rate", "regression"), ("codegen_quality (1-5)", "skipped"), ("docgen_bleu", "ok")]
    assert {r.status for r in results.gate_documents(spark, new, None, "tuned").collect()} == {"ok", "skipped"}
    assert results.read_results(spark, document("none.json")).count() == 0
    (tmp_path / "broken.json").write_text('{"metrics": {"tuned"')
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        results.read_results(spark, str(tmp_path / "broken.json")).collect()
    # Both documents at once, and the folder form of the sink.
    assert results.read_results(spark, str(tmp_path / "[on]*.json")).count() == 7
    metrics = spark.createDataFrame([("tuned", 0.5, None)], "model string, codegen_bleu double, docgen_bleu double")
    results.results_json_sink(spark.range(1), metrics, spark.range(1), str(tmp_path / "doc"), models=())
    assert rows(results.read_results(spark, str(tmp_path / "doc"))) == [("tuned", "codegen_bleu", 0.5)]


def test_of_two_promoters_the_later_is_judged_against_the_earlier(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "baseline")

    def metrics(rate):
        return spark.createDataFrame([("codegen_pass_rate", rate)], "metric string, value double")

    assert results.gate_and_promote(spark, metrics(0.5), path)
    original, tries = results._commit, []

    def overtaken(*args):
        tries.append(args[2])
        if len(tries) == 1:
            monkeypatch.setattr(results, "_commit", original)
            assert results.gate_and_promote(spark, metrics(0.9), path)
            monkeypatch.setattr(results, "_commit", overtaken)
        return original(*args)

    monkeypatch.setattr(results, "_commit", overtaken)
    # Better than 0.5, but worse than the 0.9 that became current meanwhile.
    assert results.gate_and_promote(spark, metrics(0.6), path) is False
    assert tries == [2] and results.read_baseline(spark, path).first().value == 0.9
    tries.clear()
    assert results.gate_and_promote(spark, metrics(0.95), path)
    assert rows(results.read_promotions(spark, path)) == [
        (1, "codegen_pass_rate", 0.5), (2, "codegen_pass_rate", 0.9), (3, "codegen_pass_rate", 0.9), (4, "codegen_pass_rate", 0.95),
    ]
    monkeypatch.setattr(results, "_commit", original)
    # A job that failed left metrics without a pointer.
    metrics(9.0).write.parquet(f"{path}/metrics/folder=lost")
    assert results.gate_and_promote(spark, metrics(0.96), path) and results.read_baseline(spark, path).first().value == 0.96
