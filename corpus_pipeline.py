"""From raw documents to a training mix: five stages, each stored before the next one reads it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, mixing, secret_scan, simhash, toxicity
from pairloom.storage import discard, scratch_path

# Learned steps and hashes on Python's side have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from all labels, scores below one half.

    Null and empty texts score as texts without any listed term and stay with them. Repeated rows
    and very long texts are scored like any other; an empty table stays empty. Further columns are
    kept, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    return docs.where(toxicity.toxicity(F.col("text"), lexicon) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose fingerprints link.

    Shingles of three words and at most three differing bits, as the operator has them. Texts
    without words, null ones among them, share the fingerprint zero and are one group. Repeated rows
    are one document. Of rows with the same id one of the group stays.
    """
    return simhash.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Texts without words, null ones among them, hold no passage and stay; so do all texts where the
    benchmark is empty. Repeated rows all stay or all go.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` counted again.

    A null text stays null, an empty one empty; rows without a secret do not change.
    """
    clean = docs.withColumn("text", secret_scan.redacted(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document that is left; a null text has none."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole documents table; every stage goes through a written table.

    A stage's table is deleted when the next one is written whole; the last one stays for the caller.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
