"""Joins of a large table with a side that is usually, but not provably, small."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.storage import materialise

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 256 * 1024 * 1024
# A key with fewer rows and bytes never counts as hot.
HOT_ROWS = 100_000
HOT_BYTES = 64 * 1024 * 1024


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure rows and text size of a table in one distributed aggregate."""
    size = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b"),
    ).first()
    return size["n"] <= max_rows and size["b"] <= max_bytes


def _matched(
    big: DataFrame, small: DataFrame, on: list[str], how: str, null_safe: bool, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Join on ``on`` (nulls equal each other if ``null_safe``) and ``extra``; keys come from ``big``."""
    names = {c: f"_right_{c}" for c in (*on, *extra)}
    right = small.withColumnsRenamed(names)
    same = F.lit(True)
    for c, r in names.items():
        same &= big[c].eqNullSafe(right[r]) if null_safe and c in on else big[c] == right[r]
    return big.join(right, same, how).drop(*names.values())


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    size_of: DataFrame | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join that leaves ``big`` in place while ``small`` fits a broadcast, and salts hot keys if not.

    ``small`` is read twice: materialise it first when it is costly to compute, or name in
    ``size_of`` the cheaper table to measure in its place. ``how`` is inner or left; with
    ``null_safe`` null is a key like any other. Both ways return the same rows.
    """
    if fits_broadcast(small if size_of is None else size_of, max_rows, max_bytes):
        return _matched(big, F.broadcast(small), on, how, null_safe)
    return salted_join(big, small, on, how, null_safe=null_safe)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's texts, and eight for any other column."""
    sizes = [
        F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        if isinstance(f.dataType, (T.StringType, T.BinaryType))
        else F.lit(8)
        for f in df.schema
    ]
    return sum(sizes[1:], sizes[0]).cast("long")


def hot_keys(df: DataFrame, on: list[str], min_rows: int | None = None) -> DataFrame:
    """Keys, null among them, with more rows or bytes than a quarter of an even shuffle partition,
    with a number of salts.

    At most eight times as many keys as shuffle partitions can exceed a bound. A given ``min_rows``
    takes the place of the bound in rows where that is smaller, down to the same number of keys.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = df.select(*on, row_bytes(df).alias("_b"))
    counts = sized.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.sum("_b").alias("b"))
    # All uses of the counts read one shuffle.
    least_rows, least_bytes = (HOT_ROWS, HOT_BYTES) if min_rows is None else (min_rows, HOT_BYTES)
    row_bound = F.greatest(F.lit(least_rows), F.floor(counts.agg(F.sum("n")).scalar() / (4 * partitions)))
    byte_bound = F.greatest(F.lit(least_bytes), F.floor(counts.agg(F.sum("b")).scalar() / (4 * partitions)))
    salts = F.ceil(F.greatest(F.col("n") / row_bound, F.col("b") / byte_bound)).cast("int")
    return counts.select(*on, salts.alias("_salts")).where(F.col("_salts") > 1)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    min_rows: int | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Shuffle join that spreads every hot key of ``big`` over several partitions.

    Only rows of hot keys in ``small`` are repeated. A hot null key is spread too, whether or not it
    can meet a row. ``how`` is inner or left.
    """
    hot = materialise(hot_keys(big, on, min_rows))
    # Equal rows differ in their input partition, so copies spread as well.
    plain = [
        f.name
        for f in big.schema
        if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)
    ]
    spread = F.pmod(F.xxhash64(*plain) + F.spark_partition_id(), F.col("_salts"))
    left = (
        _matched(big, F.broadcast(hot), on, "left", null_safe=True)
        .withColumn("_salt", F.coalesce(spread.cast("int"), F.lit(0)))
        .drop("_salts")
    )
    right = (
        _matched(small, F.broadcast(hot), on, "left", null_safe=True)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return _matched(left, right, on, how, null_safe, ("_salt",)).drop("_salt")
