from conftest import rows
from pyspark.sql import functions as F

from pairloom.operators.feedback import feedback_daily_counts
from pairloom.plans import feedback as plan
from pairloom.streaming.feedback import (
    daily_counts_stream,
    feedback_append_stream,
    keep_daily_counts,
    read_daily_counts,
    read_feedback_stream,
)

HEAD = "timestamp,task,prompt,response,rating\n"


def append(spark, tmp_path):
    stream = read_feedback_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    feedback_append_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return rows(spark.read.parquet(str(tmp_path / "out")).select("prompt", F.col("day").cast("string")))


def test_restarts_lose_and_double_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(HEAD + '2024-01-01 10:00:00,task_1,"p\n1",r,1\n2024-01-02 00:00:00,task_1,p2,r,0\n')
    first = [("p2", "2024-01-02"), ("p\n1", "2024-01-01")]  # in repr order
    assert append(spark, tmp_path) == first
    assert append(spark, tmp_path) == first
    # Two writers of the same day.
    (folder / "b.csv").write_text(HEAD + "2024-01-02 09:00:00,task_2,p3,r,1\n")
    (folder / "c.csv").write_text(HEAD + "2024-01-02 09:00:00,task_2,p3,r,1\n")
    assert append(spark, tmp_path) == sorted(first + [("p3", "2024-01-02")] * 2, key=repr)


def test_bad_times_stop_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(HEAD + "2024-01-01 10:00:00,task_1,p1,r,1\nbad,task_1,p2,r,1\n,task_1,p3,r,0\n")
    first = [("p1", "2024-01-01"), ("p2", None), ("p3", None)]
    assert append(spark, tmp_path) == first
    (folder / "b.csv").write_text(HEAD + "2024-13-45,task_2,p4,r,1\n2024-01-01,task_2,p5,r,1\n")
    assert append(spark, tmp_path) == sorted([*first, ("p4", None), ("p5", "2024-01-01")], key=repr)
    counts = feedback_daily_counts(spark.createDataFrame([("bad", "t"), ("2024-01-01 01:00:00", "t")], "ts string, task string"))
    assert rows(counts.select(F.col("day").cast("string"), "n_rows")) == sorted([(None, 1), ("2024-01-01", 1)], key=repr)


def test_a_batch_adds_few_files_to_a_day(spark, tmp_path):
    df = spark.range(4000).repartition(16).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 2).cast("int")).cast("string").alias("timestamp"),
        F.lit("task_1").alias("task"),
        F.col("id").cast("string").alias("prompt"),
    )
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    feedback_append_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), files_per_day=2).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4000
    assert len(list((tmp_path / "out").glob("day=*/part*"))) <= 4


def test_running_daily_counts_equal_batch_counts(spark, tmp_path):
    df = spark.range(200).select(
        F.timestamp_seconds(F.col("id") * 3000 + 1_700_000_000).alias("ts"),
        F.when(F.col("id") % 3 == 0, "task_1").otherwise("task_2").alias("task"),
    )
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        daily_counts_stream(stream)
        .writeStream.format("memory")
        .queryName("daily")
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert rows(spark.table("daily")) == rows(feedback_daily_counts(df))


def test_a_run_reads_only_new_files(spark, tmp_path, monkeypatch):
    folder, out, state = tmp_path / "in", tmp_path / "out", str(tmp_path / "state")
    folder.mkdir()

    def collect():
        return [tuple(r) for r in plan.collect_new_feedback(spark, str(folder), str(out), state, files_per_batch=1).collect()]

    def stored(name, *columns):
        return rows(spark.read.json(f"{out}/{name}").select(*columns)) if any(out.glob(f"{name}/*/part*")) else []

    assert collect() == []
    (folder / "feedback_1.csv").write_text(HEAD + 't1,task_1,"p\n1",r1,1\nt2,task_2,p2,r2,0\nt3,task_1,p3,r3,abc\nt4,task_1\n')
    (folder / "notes.csv").write_text(HEAD + "t,task_1,p,r,1\n")
    assert collect() == [(2, 1, 1, 50, 50, 1, 1)]
    # A file that was read is not read again, whatever became of it.
    (folder / "feedback_1.csv").write_text("gone")
    (folder / "feedback_2.csv").write_text("rating,extra,response,prompt,task,timestamp\n1,e,r5,p5,task_2,t5\n")
    (folder / "feedback_3.csv").write_text("prompt,rating\np,1\n")
    assert collect() == collect() == [(3, 2, 1, 67, 33, 1, 2)]
    assert stored("all_feedback", "file", "prompt", "rating") == [
        ("feedback_1.csv", "p2", 0),
        ("feedback_1.csv", "p\n1", 1),
        ("feedback_2.csv", "p5", 1),
    ]
    assert stored("rejected", "prompt", "reason") == [("", "field"), ("p3", "rating")]
    assert len(stored("training_pairs", "text")) == 2
    assert sum(r.rejected for r in plan.read_totals(spark, str(out)).collect()) == 2


def test_a_batch_that_runs_twice_leaves_one_copy(spark, tmp_path, monkeypatch):
    folder, out, state = tmp_path / "in", tmp_path / "out", str(tmp_path / "state")
    folder.mkdir()
    (folder / "feedback_1.csv").write_text(HEAD + "t1,task_1,p1,r1,1\nt2,task_2,p2,r2,0\n")
    original, calls = plan.feedback_totals, []

    def stopped(df):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("the driver is lost after rows and pairs are written")
        return original(df)

    monkeypatch.setattr(plan, "feedback_totals", stopped)
    try:
        plan.collect_new_feedback(spark, str(folder), str(out), state)
    except Exception as error:
        assert "driver is lost" in str(error)
    assert spark.read.json(f"{out}/all_feedback").count() == 2 and plan.read_totals(spark, str(out)).count() == 0
    assert plan.collect_new_feedback(spark, str(folder), str(out), state).first().total == 2
    assert spark.read.json(f"{out}/all_feedback").count() == 2
    assert spark.read.json(f"{out}/training_pairs").count() == 1


def test_kept_daily_counts_survive_a_stop(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    data = [(f"2024-01-0{1 + i % 3} 10:00:00" if i % 7 else None, f"task_{i % 2}") for i in range(60)]
    df = spark.createDataFrame(data, "ts string, task string").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (df.limit(25), df.limit(0), df.offset(25)):
        part.write.mode("append").parquet(folder)
        stream = read_feedback_stream(spark, folder, "parquet", df.schema, files_per_trigger=1)
        keep_daily_counts(stream, out, state).awaitTermination()
    assert rows(read_daily_counts(spark, out)) == rows(feedback_daily_counts(df))
    # The last batch once more.
    newest = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("batch=*"))
    spark.read.parquet(f"{out}/batch={newest}").write.mode("append").parquet(f"{out}/batch={newest}")
    assert rows(read_daily_counts(spark, out)) == rows(feedback_daily_counts(df))
