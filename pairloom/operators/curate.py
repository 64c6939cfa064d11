"""Union, projection, length filter and prefixes of pair tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import space_pieces
from pairloom.operators.joins import lookup_join
from pairloom.schemas import FIRST_N, MAX_PIECES, PAIR_COLUMNS, SPLIT_ORDER
from pairloom.storage import materialise


def union_splits(splits: dict[str, DataFrame], ord_col: str) -> DataFrame:
    """Train, validation and test in this order, copies kept; other splits are ignored.

    The order is carried by ``split_rank`` and ``ord``, rows are not sorted.
    """
    parts = [
        splits[name].select(
            "*",
            F.lit(name).alias("split"),
            F.lit(rank).alias("split_rank"),
            F.col(ord_col).alias("ord"),
        )
        for rank, name in enumerate(SPLIT_ORDER)
        if name in splits
    ]
    return reduce(DataFrame.unionByName, parts)


def project_pairs(df: DataFrame, task: str, id_col: str = "ex_id") -> DataFrame:
    """The two columns of the task under common names."""
    prompt, answer = PAIR_COLUMNS[task]
    return df.select(
        F.col(id_col).alias("ex_id"),
        F.lit(task).alias("task"),
        F.col(prompt).alias("prompt"),
        F.col(answer).alias("answer"),
        *[c for c in ("split", "split_rank", "ord") if c in df.columns],
    )


def drop_null_pairs(df: DataFrame) -> DataFrame:
    return df.where(F.col("prompt").isNotNull() & F.col("answer").isNotNull())


def null_pair_counts(df: DataFrame) -> DataFrame:
    """Rows per task and how many of them lack a prompt or an answer."""
    missing = F.col("prompt").isNull() | F.col("answer").isNull()
    return df.groupBy("task").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_dropped")
    )


def length_filter(df: DataFrame, max_len: int = MAX_PIECES) -> DataFrame:
    """Rows whose prompt and answer have fewer than ``max_len`` single-space pieces together."""
    return df.where(space_pieces(F.col("prompt")) + space_pieces(F.col("answer")) < max_len)


def mark_ties(ties: DataFrame, quota: DataFrame, group: list[str]) -> DataFrame:
    """Add ``_taken``: true for exactly ``_quota`` rows of each group that ``quota`` names.

    For rows that nothing orders any further. They are numbered where they are stored: counts per
    partition are added up first, then each partition numbers its own rows, so a group of any size
    is never in one task.
    """
    stored = materialise(ties.withColumn("_row", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_row", 33)
    )
    counts = stored.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(along), F.lit(0))
    offsets = lookup_join(counts, quota, group, null_safe=True).select(
        *group, "_part", (F.col("_quota") - before).alias("_left")
    )
    own = Window.partitionBy(*group, "_part").orderBy("_row")
    numbered = lookup_join(stored, materialise(offsets), [*group, "_part"], null_safe=True)
    taken = F.row_number().over(own) <= F.col("_left")
    return numbered.select(*ties.columns, taken.alias("_taken"))


def _prefix_bound(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """Order key of the n-th row per group (of the last row in smaller groups), and how many rows of
    that key are among the first n.

    Only keys move. A salted round comes first, so a group is never sorted in one task.
    """
    spark = df.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*group, *order).withColumn(
        "_salt", F.pmod(F.xxhash64(*order) + F.spark_partition_id(), F.lit(salts)).cast("int")
    )
    by = [F.col(c) for c in order]
    local = Window.partitionBy(*group, "_salt").orderBy(*by)
    final = Window.partitionBy(*group).orderBy(*by)
    first = (
        keys.withColumn("_r", F.row_number().over(local))
        .where(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(final))
        .where(F.col("_r") <= n)
    )
    last = F.max(_key(order)).over(Window.partitionBy(*group))
    return (
        first.withColumn("_bound", last)
        .where(_key(order) == F.col("_bound"))
        .groupBy(*group, "_bound")
        .agg(F.count(F.lit(1)).alias("_quota"))
    )


def _key(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _upto(bounded: DataFrame, order: list[str], group: list[str], columns: list[str]) -> DataFrame:
    """Rows up to ``_bound``; of the rows at the bound, ``_quota`` of each group."""
    kept = bounded.where(_key(order) <= F.col("_bound"))
    at_bound = bounded.where(_key(order) == F.col("_bound"))
    surplus = (
        at_bound.groupBy(*group, "_quota")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > F.col("_quota"))
        .drop("_n")
    )
    surplus = materialise(surplus)
    if surplus.isEmpty():
        return kept.select(*columns)
    tied = lookup_join(at_bound.drop("_quota"), surplus, group, null_safe=True).drop("_quota")
    marked = lookup_join(kept.drop("_quota"), surplus, group, "left", null_safe=True)
    rest = marked.where(F.col("_quota").isNull() | (_key(order) < F.col("_bound")))
    chosen = mark_ties(tied, surplus, group).where("_taken")
    return rest.select(*columns).unionByName(chosen.select(*columns))


def first_n(df: DataFrame, n: int = FIRST_N, order: tuple[str, ...] = ("split_rank", "ord")) -> DataFrame:
    """The first ``n`` rows in source order; of rows with equal keys at the end, as many as fit.

    The n-th key is found on key columns alone; full rows are then only filtered, not shuffled.
    Nulls come first.
    """
    order = list(order)
    prefix = df.select(*order).orderBy(*order).limit(n)
    counted = prefix.groupBy(_key(order).alias("_bound")).agg(F.count(F.lit(1)).alias("_quota"))
    last = materialise(counted.agg(F.max(F.struct("_bound", "_quota")).alias("m")))
    marks = {c: last.select(f"m.{c}").scalar() for c in ("_bound", "_quota")}
    return _upto(df.withColumns({"_one": F.lit(0), **marks}), order, ["_one"], df.columns)


def sample_per_task(
    df: DataFrame, n: int, order: tuple[str, ...] = ("ord",), group: tuple[str, ...] = ("task",)
) -> DataFrame:
    """The first ``n`` rows of each task in source order; rows without a task are one group.

    Of rows with equal keys at the end of a group, as many as fit.
    """
    order, group = list(order), list(group)
    bounds = materialise(_prefix_bound(df, group, order, n))
    return _upto(lookup_join(df, bounds, group, null_safe=True), order, group, df.columns)
