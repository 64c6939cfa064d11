"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets in words: sources, by code point with null last, weigh ``weights`` in turn and share
``budget`` times all words; no target exceeds ``most`` times its source's size, and what is over is
shared again by weight. A source is taken whole as often as its target allows; the rest is a
weighted sample without replacement: every document draws an exponential key divided by its quality
weight, and documents are taken by rising key while the middle of their words lies within the rest.

The order is found without sorting a source: sizes are summed per bin of the logarithm of the key,
bins are prefix-summed, and only rows of the bin that holds the cut are ordered. Draws depend on the
seed, the id and the text, so reruns agree. Null texts have size 0 and are taken 0 times; repeated
rows draw equal keys and are taken one after the other; an empty table gives an empty mix.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.words import small, space_words
from pairloom.storage import materialise

WEIGHTS = (3, 1, 2)
# Bins per factor e of the key: the fullest holds less than 1/2,700 of a source of equal weights.
BINS = 1024
LEAST_QUALITY = 1e-9


def text_quality(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: near 1 for long texts whose words have about six characters."""
    chars = F.length(F.coalesce(text, F.lit(""))).cast("double")
    spread = F.abs(chars / F.greatest(size, F.lit(1)) - 6.0) / 6.0
    return F.greatest(size, F.lit(1)).cast("double") / (size + 20) / (1.0 + spread)


def in_order(rows: DataFrame, order: Column) -> DataFrame:
    """The rows stored in ranges of ``order``, which has no ties; ``part`` numbers the ranges from below."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.repartitionByRange(ranges, order).withColumn("part", F.spark_partition_id()))


def offsets(ordered: DataFrame, **sums: Column) -> DataFrame:
    """For each ``part``, the sums over all earlier parts, and with ``later_`` before the name over all
    later ones. Windows here hold a row per part."""
    parts = ordered.groupBy("part").agg(*[value.alias(name) for name, value in sums.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    found = [F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"earlier_{name}") for name in sums]
    found += [F.coalesce(F.sum(name).over(after), F.lit(0)).alias(f"later_{name}") for name in sums]
    return F.broadcast(parts.select("part", *found))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of ``source`` and ``size``.

    Water filling in closed form: with sources ordered by cap over weight, the level is the largest
    of (budget - caps before) / (weights from here on). Sources are ranked and summed in ranges, so
    that no task holds all of them.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranged = in_order(totals, F.col("source").asc_nulls_last())
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    rank = F.col("earlier_n") + F.row_number().over(inside) - 1
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = (
        ranged.join(offsets(ranged, n=F.count(F.lit(1))), "part")
        .withColumn("w", share)
        .select("source", "source_size", "w", (F.col("source_size") * F.lit(float(most))).alias("cap"))
    )
    filling = in_order(weighed, F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source"))
    order = Window.partitionBy("part").orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))
    here_on = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    all_words = filling.agg(F.sum("source_size")).first()[0] or 0
    level = (
        F.lit(all_words * float(budget)) - (F.col("earlier_cap") + F.coalesce(before, F.lit(0.0)))
    ) / (F.col("later_w") + here_on)
    at = filling.join(offsets(filling, cap=F.sum("cap"), w=F.sum("w")), "part").select(level.alias("level"))
    highest = at.agg(F.max("level")).first()[0] or 0.0
    return filling.select(
        "source", "source_size", F.least("cap", F.col("w") * F.lit(highest)).alias("target")
    )


def mix(
    docs: DataFrame,
    quality: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    budget: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` for every document.

    ``quality`` is a weight over the columns of ``docs``; :func:`text_quality` by default. Weights that
    are null, not a number or not positive count as the least weight and come last.
    """
    size = F.size(space_words(F.col("text"))).cast("long")
    digest = F.md5(
        F.concat_ws(
            ":",
            F.lit(seed),
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            F.md5(F.coalesce("text", F.lit("")).cast("binary")),
        ).cast("binary")
    )
    given = text_quality(F.col("text"), size) if quality is None else quality.cast("double")
    weight = F.greatest(F.coalesce(F.nanvl(given, F.lit(0.0)), F.lit(0.0)), F.lit(LEAST_QUALITY))
    sized = docs.select(
        "doc_id",
        "source",
        size.alias("size"),
        weight.alias("q"),
        ((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)).alias("u"),
    )
    keyed = sized.select("doc_id", "source", "size", (-F.log("u") / F.col("q")).alias("key"))
    rows = materialise(keyed.withColumn("bin", F.floor(F.log("key") * BINS)))
    targets = source_targets(rows, weights, budget, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    along = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    upto = bins.withColumn("upto", F.sum("bin_size").over(along))
    cut = (
        plan.alias("p")
        .join(upto.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")), "left")
        .where("b.bin is null or b.upto > p.rest")
        .groupBy(F.col("p.source").alias("src"), "source_size", "target", "epochs", "rest")
        .agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("base"))).alias("c"))
        .select("src", "source_size", "target", "epochs", "rest", F.col("c.bin").alias("cut_bin"), F.col("c.base").alias("base"))
    )
    # A source without a cut has only empty texts; it takes nothing.
    full = plan.select(F.col("source").alias("src"), "source_size", "target", "epochs", "rest").join(
        cut.select(F.col("src").alias("c_src"), "cut_bin", "base"),
        F.col("src").eqNullSafe(F.col("c_src")),
        "left",
    )
    decided = rows.join(small(materialise(full.drop("c_src"))), F.col("source").eqNullSafe(F.col("src")))
    at_cut = decided.where(F.col("bin") == F.col("cut_bin"))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    middle = F.col("base") + F.sum("size").over(inside) - F.col("size") / 2
    ordered = at_cut.withColumn("chosen", middle <= F.col("rest"))
    others = decided.where(F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin"))).withColumn(
        "chosen", F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(False))
    )
    taken = F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))
    return ordered.unionByName(others).select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken")
    )
