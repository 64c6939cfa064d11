"""Inputs of the operators derived from the driver's tables."""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.joins import lookup_join
from pairloom.schemas import CODE_TASK, DOC_TASK, MODELS

IDS_PER_CONVERSATION = 1_000_000
CASES_PER_SAMPLE = 4
SAMPLES_PER_FILE = 250


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a table is read in fewer partitions than there are; large tables stay put."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def _div(value: Column, n: int) -> Column:
    """Whole-number division without a detour through doubles."""
    return F.call_function("div", value, F.lit(n))


def _task(sample_id, n: int):
    return F.when(sample_id * 2 < n, CODE_TASK).otherwise(DOC_TASK)


def _run_keys(gen_id, n: int) -> list:
    """A run asks every model for every sample once; ids count samples, then models, then runs."""
    which = _div(gen_id, n) % len(MODELS)
    return [
        _div(gen_id, n * len(MODELS)).alias("run_id"),
        (gen_id % n).alias("sample_id"),
        F.when(which == 0, MODELS[0]).when(which == 1, MODELS[1]).otherwise(MODELS[2]).alias("model"),
    ]


class Tables:
    """Views of one data folder; sizes are counted once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def n_samples(self) -> int:
        return self.table("benchmark").count()

    @cached_property
    def n_generations(self) -> int:
        return self.table("documents").count()

    def documents(self, *cols: str) -> DataFrame:
        return spread(self.table("documents").select(*cols))

    def pairs(self) -> DataFrame:
        """Each user turn with the assistant turn after it. (conv_id, turn) is unique."""
        turns = self.table("conversations")
        asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
        replied = turns.where(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
        )
        digit = F.col("conv_id") % 10
        return asked.join(replied, ["conv_id", "turn"]).select(
            (F.col("conv_id") * IDS_PER_CONVERSATION + F.col("turn")).alias("ex_id"),
            F.when(F.col("conv_id") % 2 == 0, "task_1").otherwise("task_2").alias("task"),
            F.when(digit == 0, "test").when(digit == 1, "validation").otherwise("train").alias("split"),
            "prompt",
            "answer",
        )

    def samples(self) -> DataFrame:
        n = self.n_samples
        task = _task(F.col("item_id"), n)
        return self.table("benchmark").select(
            F.col("item_id").alias("sample_id"),
            task.alias("task"),
            F.when(task == CODE_TASK, F.concat(F.lit("fn_"), F.col("item_id").cast("string"))).alias(
                "function_name"
            ),
            F.when(
                task == DOC_TASK,
                F.when(
                    F.col("item_id") % 4 == 3,
                    F.concat(F.lit("def doc_"), F.col("item_id").cast("string"), F.lit("(x):\n    pass")),
                ).otherwise(F.col("text")),
            ).alias("code"),
        )

    def references(self) -> DataFrame:
        return self.table("benchmark").select(
            F.col("item_id").alias("sample_id"), F.col("text").alias("reference")
        )

    def run_samples(self) -> DataFrame:
        """Every sample in every run, also where the last run is incomplete."""
        n, total = self.n_samples, self.n_generations
        runs = (total - 1) // (n * len(MODELS)) + 1
        ids = self.spark.range(runs * n).select(
            _div(F.col("id"), n).alias("run_id"), (F.col("id") % n).alias("sample_id")
        )
        return lookup_join(ids, self.samples(), ["sample_id"])

    def generations(self) -> DataFrame:
        n = self.n_samples
        docs = self.documents("doc_id", "text", "n_chars")
        score = (F.col("doc_id") * 7 % 8).cast("string")
        return docs.select(
            F.col("doc_id").alias("gen_id"),
            *_run_keys(F.col("doc_id"), n),
            _task(F.col("doc_id") % n, n).alias("task"),
            F.col("text").alias("raw_response"),
            F.concat(F.lit("Score: "), score).alias("judge_response"),
            (F.col("n_chars") % 3).cast("double").alias("memory_mb"),
        )

    def telemetry(self) -> DataFrame:
        """Latency under the keys of a generation; ids beyond the last generation match none."""
        return self.table("events").select(
            *_run_keys(F.col("event_id"), self.n_samples), F.round("value", 1).alias("latency_ms")
        )

    def outcomes(self) -> DataFrame:
        """Test cases of all generations; no actual value means that the case raised an error."""
        n, total = self.n_samples, self.n_generations
        events = spread(self.table("events").select("event_id", "user_id", "event_type", "value"))
        kind = F.col("event_id") % 3
        user = F.col("user_id").cast("string")
        text = F.concat(F.lit('"'), "event_type", F.lit('"'))
        # Equal values come in different spellings.
        expected = F.when(kind == 0, text).when(kind == 1, user).otherwise("[true,1]")
        equal = F.when(kind == 0, text).when(kind == 1, F.concat(user, F.lit(".0"))).otherwise("[1, 1.0]")
        return events.select(
            *_run_keys(F.col("event_id") % total, n),
            _div(F.col("event_id"), total).alias("case_idx"),
            expected.alias("expected"),
            F.when(F.col("value") < 60, equal).when(F.col("value") < 90, '"other"').alias("actual"),
        )

    def raw_responses(self) -> DataFrame:
        """Code-like model output made from the attributes of each document, prose for the seventh kind."""
        fence = "```"
        kind = F.col("doc_id") % 7
        lit = F.lit
        raw = (
            F.when(kind == 0, F.concat(lit("no function here "), "source", lit(" ")))
            .when(
                kind == 1,
                F.concat(
                    lit(f"Sure.\n{fence}python\ndef f_"),
                    "lang",
                    lit(f"(x):\n    y = x\n\n    return y\n{fence}\nDone"),
                ),
            )
            .when(
                kind == 2,
                F.concat(lit("class A:\n    def g(self):\n        return '"), "source", lit("'\n    z = 2")),
            )
            .when(
                kind == 3,
                F.concat(lit("def h():\n    return '"), "lang", lit("'\n# note\ndef k():\n    return 2")),
            )
            .when(kind == 4, F.concat(lit('"""Doc '), "lang", lit('."""')))
            .when(kind == 5, F.concat(lit(f'{fence}python\n"""Doc '), "source", lit(f'."""\n{fence}')))
            .otherwise(F.concat(lit("'"), "text", lit("'")))
        )
        return self.documents("doc_id", "text", "lang", "source").select("doc_id", raw.alias("raw"))

    def feedback_raw(self) -> DataFrame:
        i = F.col("event_id")
        rating = (
            F.when(i % 97 == 0, "n/a")
            .when(i % 89 == 0, "1.0")
            .when(i % 83 == 0, " 1 ")
            .when(i % 79 == 0, "1_0")
            .when(i % 73 == 0, "")
            .when(F.col("value") < 40, "1")
            .otherwise("0")
        )
        return self.table("events").select(
            "event_id",
            F.concat(F.lit("feedback_"), F.to_date("ts").cast("string"), F.lit(".csv")).alias("file"),
            "ts",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
            F.when(F.col("user_id") % 3 == 0, "task_1").otherwise("task_2").alias("task"),
            F.col("event_type").alias("prompt"),
            F.col("props").alias("response"),
            rating.alias("rating_raw"),
        )

    def eval_documents(self) -> DataFrame:
        """JSON arrays of evaluation samples, one array per ``file``.

        Every four consecutive events are the test cases of a code sample; groups are bounded by that.
        Every other group describes a docstring sample instead.
        """
        i, value = F.col("event_id"), F.col("value").cast("decimal(18,2)").cast("string")
        kind = F.concat(F.lit('"'), "event_type", F.lit('"'))
        expected = (
            F.when(i % 3 == 0, F.col("user_id").cast("string"))
            .when(i % 3 == 1, F.when(F.col("value") < 50, "true").otherwise("false"))
            .otherwise(kind)
        )
        grouped = (
            self.table("events")
            .select(
                _div(i, CASES_PER_SAMPLE).alias("id"),
                i,
                "props",
                F.concat(F.lit("["), value, F.lit(","), kind, F.lit("]")).alias("input"),
                expected.alias("expected"),
            )
            .groupBy("id")
            .agg(
                F.array_sort(F.collect_list(F.struct("event_id", "input", "expected"))).alias("cases"),
                F.min_by("props", "event_id").alias("props"),
            )
        )
        parsed = F.transform(
            "cases",
            lambda c: F.struct(
                F.parse_json(c["input"]).alias("input"), F.parse_json(c["expected"]).alias("expected")
            ),
        )
        is_code = F.col("id") % 2 == 0
        name = F.concat(F.lit("fn_"), F.col("id").cast("string"))
        code = F.concat(F.lit("def "), name, F.lit("(x):\n    return x"))
        sample = F.to_json(
            F.struct(
                "id",
                F.when(is_code, CODE_TASK).otherwise(DOC_TASK).alias("task"),
                F.when(is_code, F.col("props")).alias("prompt"),
                F.when(is_code, name).alias("function_name"),
                F.when(is_code, code).alias("reference_code"),
                F.when(is_code, parsed).alias("test_cases"),
                F.when(~is_code, code).alias("code"),
                F.when(~is_code, F.concat(F.lit("Returns "), "props")).alias("reference_docstring"),
            )
        )
        return (
            grouped.select("id", sample.alias("sample"))
            .groupBy(_div(F.col("id"), SAMPLES_PER_FILE).alias("file"))
            .agg(F.array_sort(F.collect_list(F.struct("id", "sample"))).alias("s"))
            .select(
                "file",
                F.concat(
                    F.lit("["), F.array_join(F.transform("s", lambda x: x["sample"]), ","), F.lit("]")
                ).alias("value"),
            )
        )

    def daily_params(self) -> DataFrame:
        """Parameter sets of one run per day: (run_id, key, value)."""
        return (
            self.table("events")
            .groupBy(
                F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("run_id"),
                F.concat_ws(".", F.lit("training"), "event_type", F.col("user_id").cast("string")).alias("key"),
            )
            .agg(F.max("props").alias("value"))
        )
