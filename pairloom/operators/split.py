"""Exact seeded split and counts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.curate import mark_ties
from pairloom.operators.joins import lookup_join
from pairloom.schemas import SPLIT_SEED, TRAIN_FRACTION
from pairloom.storage import materialise

# Leading hex digits of the hash that form a bucket: 65,536 buckets per task.
BUCKET_DIGITS = 4


def _hash(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def split_bounds(
    df: DataFrame, frac: float, seed: int, key: str, group: str, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Per group the (hash, key) at which the training part ends: ``_b``, ``_bound``, the rows ``_n``
    with that key and how many of them, ``_quota``, belong to the training part.

    Rows are counted per hash bucket; only the bucket that holds the cut is ranked, after copies of
    a key have been counted together.
    """
    keys = df.select(group, key).withColumn("_h", _hash(seed, key))
    keys = keys.withColumn("_b", F.substring("_h", 1, digits))
    buckets = materialise(keys.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("n")))
    running = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    cut = (
        buckets.withColumn("_upto", F.sum("n").over(running))
        .withColumn("_want", F.floor(F.lit(frac) * F.sum("n").over(whole)))
        .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("n") < F.col("_want")))
        .select(group, "_b", (F.col("_want") - (F.col("_upto") - F.col("n"))).alias("_take"))
    )
    cut = materialise(cut)
    ranked = Window.partitionBy(group).orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)
    # The first key whose rows reach the number to take.
    reached = F.struct("_h", F.col(key).alias("_k"), "n", (F.col("_take") - F.col("_rank") + F.col("n")).alias("_quota"))
    first = (
        lookup_join(keys, cut, [group, "_b"], null_safe=True)
        .groupBy(group, "_b", "_h", key, "_take")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_rank", F.sum("n").over(ranked))
        .groupBy(group, "_b")
        .agg(F.min(F.when(F.col("_rank") >= F.col("_take"), reached)).alias("_r"))
    )
    return first.select(
        group,
        "_b",
        F.struct(F.col("_r._h").alias("_h"), F.col("_r._k").alias("_k")).alias("_bound"),
        F.col("_r.n").alias("_n"),
        F.col("_r._quota").alias("_quota"),
    )


def exact_split(
    df: DataFrame,
    frac: float = TRAIN_FRACTION,
    seed: int = SPLIT_SEED,
    key: str = "ex_id",
    group: str = "task",
    digits: int = BUCKET_DIGITS,
    keep_copies: bool = False,
) -> DataFrame:
    """Add ``part``: exactly floor(frac * n) rows per group are ``train``, the rest ``validation``.

    Order is md5 of seed and key; rows without a group are one group. The rows themselves are neither
    shuffled nor sorted. If the cut falls between copies of a key, some of them are training data;
    with ``keep_copies`` none of them is, and the training part is smaller than the fraction.
    """
    bounds = materialise(split_bounds(df, frac, seed, key, group, digits))
    h = _hash(seed, key)
    place = F.struct(h.alias("_h"), F.col(key).alias("_k"))
    joined = lookup_join(df, bounds, [group], "left", null_safe=True)
    # Buckets below the cut are training data even if no row of the cut bucket is.
    inside = (F.substring(h, 1, digits) < F.col("_b")) | (place < F.col("_bound"))
    at_cut = place == F.col("_bound")
    whole = at_cut & (F.col("_n") == F.col("_quota"))
    part = F.when(F.coalesce(inside | whole, F.lit(False)), "train").otherwise("validation")
    parts = joined.withColumn("part", part)
    columns = [*df.columns, "part"]
    partial = F.coalesce(at_cut & (F.col("_n") > F.col("_quota")), F.lit(False))
    if keep_copies or bounds.where("_n > _quota").isEmpty():
        return parts.select(*columns)
    quota = bounds.where("_n > _quota").select(group, "_quota")
    ties = mark_ties(joined.where(partial).select(*df.columns), quota, [group])
    shared = ties.withColumn("part", F.when(F.col("_taken"), "train").otherwise("validation"))
    return parts.where(~partial).select(*columns).unionByName(shared.select(*columns))


def split_counts(df: DataFrame, cols: tuple[str, ...] = ("task", "part")) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))
