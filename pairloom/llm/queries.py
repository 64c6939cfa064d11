"""Each operator over its whole table, with the result columns that its query promises."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import (
    decontaminate,
    hard_negatives,
    language,
    lattice,
    mixing,
    multi_index,
    packing,
    quality,
    secret_scan,
    simhash,
    toxicity,
    warc,
    whitening,
)
from pairloom.llm.words import fold_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    print_ = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", print_.alias("fingerprint"), "component_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op4_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(fold_of(F.col("doc_id"), 3) != 1))
    held_out = (fold_of(F.col("doc_id"), 3) == 1).alias("held_out")
    return language.languages(docs, model).select("doc_id", held_out, "lang_pred", "score", "spans")


def op5_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lattice.score(docs, fold_of(F.col("doc_id"), 7) != 2)
    return found.withColumn("held_out", fold_of(F.col("doc_id"), 7) == 2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(fold_of(F.col("doc_id"), 5) != 0))
    held_out = (fold_of(F.col("doc_id"), 5) == 0).alias("held_out")
    scored = docs.select("doc_id", held_out, toxicity.toxicity(F.col("text"), lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop("text_hash")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranker = quality.learn(docs, labels.where(fold_of(F.col("doc_id"), 5) != 0))
    held_out = (fold_of(F.col("doc_id"), 5) == 0).alias("held_out")
    scored = docs.select("doc_id", held_out, quality.quality(F.col("text"), ranker).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), "vec_id % 100 = 0")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_derivatives,
        op2_simhash_trie,
        op3_source_mix,
        op4_language_viterbi,
        op5_subword_lattice,
        op6_toxicity,
        op7_decontaminate,
        op8_secrets,
        op9_quality_ranking,
        op10_multi_index,
        op11_hard_negatives,
        op12_whitening,
        op13_best_fit_packing,
    )
}
