"""Words, stable shares and bounded label samples that several operators use."""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.joins import fits_broadcast

SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def pieces(text: Column, separator: str) -> Column:
    """Non-empty pieces between separators; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Texts of one byte per character take the fast way; the result is the same."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def space_words(text: Column) -> Column:
    return pieces(text, SPACE)


def alnum_words(text: Column) -> Column:
    return pieces(ascii_lower(text), NOT_ALNUM)


def is_small(table: DataFrame) -> bool:
    """Whether the table's measured size allows a broadcast."""
    return fits_broadcast(table, max_rows=500_000, max_bytes=64 << 20)


def small(table: DataFrame) -> DataFrame:
    """The table with a broadcast hint if its measured size allows one; else joins shuffle it."""
    return F.broadcast(table) if is_small(table) else table


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id`` and ``label`` of every labelled id, once. Ids with a null label, or with rows that disagree, teach nothing."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("most"))
        .where("label = most")
        .select("doc_id", "label")
    )


def bounded_labels(labels: DataFrame, label: str, max_rows: int, seed: str) -> DataFrame:
    """At most about ``max_rows`` of the known labels of each value, chosen by a hash of the id.

    The result has ``doc_id`` and ``label``; its size is bounded by the number of values, so it may be
    broadcast.
    """
    known = known_labels(labels, label)
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    return (
        known.join(F.broadcast(counts), "label")
        .where(share * F.col("n") < max_rows)
        .select("doc_id", "label")
    )
