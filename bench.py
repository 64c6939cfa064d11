"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES a comma-separated choice.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from bindings.queries import ALL  # noqa: E402

HEADLINE = (
    "length_filter",
    "first_n",
    "build_vocab",
    "encode_tokens",
    "pad_right",
    "exact_split",
    "extract_function",
    "clean_docstring",
    "tokenize_text",
    "ngram_counts",
    "bleu",
    "test_pass_rate",
    "fill_skipped",
    "assemble_results",
    "compute_metrics",
    "regression_gate",
    "parse_feedback",
    "feedback_summary",
    "feedback_append_stream",
    "feedback_daily_counts",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    ALL[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(HEADLINE)
    spark = session(cpus)
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(small):  # start the workers and compile hot paths before timing
        for name in names:
            timed(spark, small, name)
    times = {name: round(timed(spark, sf_dir, name), 3) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
