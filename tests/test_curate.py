import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from pairloom.operators import curate, split
from pairloom.operators.joins import hot_keys, lookup_join, salted_join


def pairs(spark, n):
    return spark.range(n).select(
        F.col("id").alias("ex_id"),
        F.when(F.col("id") % 3 == 0, "task_1").otherwise("task_2").alias("task"),
        F.concat(F.lit("p "), F.col("id").cast("string")).alias("prompt"),
        F.lit("a").alias("answer"),
    )


def test_union_keeps_copies_and_ignores_other_splits(spark):
    df = pairs(spark, 3)
    got = curate.union_splits({"test": df, "extra": df, "train": df}, "ex_id")
    assert rows(got.select("split", "split_rank", "ord")) == sorted(
        [("train", 0, i) for i in range(3)] + [("test", 2, i) for i in range(3)], key=repr
    )


def test_length_filter_counts_single_spaces(spark):
    df = spark.createDataFrame(
        [("a " * 598, "b"), ("a " * 597, "b"), ("\n" * 900, ""), (None, "b")], "prompt string, answer string"
    )
    kept = curate.length_filter(df).collect()
    assert [len(r.prompt) for r in kept] == [1194, 900]


@pytest.mark.parametrize("layout", [1, 7])
def test_first_n_follows_source_order(spark, layout):
    df = pairs(spark, 1000).withColumns({"split_rank": F.col("ex_id") % 2, "ord": 1000 - F.col("ex_id")})
    got = curate.first_n(df.repartition(layout), 600).select("ex_id")
    want = sorted(range(1000), key=lambda i: (i % 2, 1000 - i))[:600]
    assert rows(got) == sorted([(i,) for i in want], key=repr)
    assert curate.first_n(df, 5000).count() == 1000
    assert curate.first_n(df.where("false"), 5).count() == 0


def test_sample_per_task(spark):
    df = pairs(spark, 500).withColumn("ord", -F.col("ex_id"))
    got = curate.sample_per_task(df, 120).select("task", "ex_id")
    want = [("task_1", i) for i in range(499, -1, -1) if i % 3 == 0][:120]
    want += [("task_2", i) for i in range(499, -1, -1) if i % 3][:120]
    assert rows(got) == sorted(want, key=repr)
    assert curate.sample_per_task(df, 1000).count() == 500


def test_null_pairs_are_dropped_and_counted(spark):
    df = spark.createDataFrame([("t", "p", None), ("t", "p", "a")], "task string, prompt string, answer string")
    assert curate.drop_null_pairs(df).count() == 1
    assert rows(curate.null_pair_counts(df)) == [("t", 2, 1)]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 999])
@pytest.mark.parametrize("digits", [1, 4])
def test_split_is_exact_and_complete(spark, n, digits):
    df = pairs(spark, n)
    out = split.exact_split(df, digits=digits)
    per_task = {t: c for t, c in rows(df.groupBy("task").count())}
    train = {t: c for t, c in rows(out.where("part = 'train'").groupBy("task").count())}
    assert out.count() == n
    assert train == {t: int(0.8 * c) for t, c in per_task.items() if int(0.8 * c)}


def test_split_does_not_depend_on_layout(spark):
    df = pairs(spark, 400)
    want = rows(split.exact_split(df.repartition(1)))
    assert rows(split.exact_split(df.repartition(7))) == want
    assert rows(split.exact_split(df, seed=43)) != want


def copies(spark):
    """One key holds a third of all rows."""
    key = F.when(F.col("id") < 200, F.lit(0)).otherwise(F.col("id"))
    return spark.range(600).repartition(5).select(key.alias("ex_id"), F.lit("t").alias("task"))


@pytest.mark.parametrize("seed", range(42, 47))
def test_split_is_exact_with_copies(spark, seed):
    out = split.exact_split(copies(spark), seed=seed)
    assert rows(out.groupBy("part").count()) == [("train", 480), ("validation", 120)]
    mixed = out.groupBy("ex_id").agg(F.count_distinct("part").alias("n")).where("n > 1")
    assert mixed.count() <= 1
    together = split.exact_split(copies(spark), seed=seed, keep_copies=True)
    assert together.count() == 600 and together.where("part = 'train'").count() <= 480
    assert together.groupBy("ex_id").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0


def test_rows_without_a_group_are_one_group(spark):
    df = pairs(spark, 30).withColumns(
        {"task": F.when(F.col("ex_id") % 3 > 0, F.lit("t")), "ord": F.col("ex_id")}
    )
    assert rows(split.split_counts(split.exact_split(df))) == sorted(
        [(None, "train", 8), (None, "validation", 2), ("t", "train", 16), ("t", "validation", 4)], key=repr
    )
    assert rows(curate.sample_per_task(df, 4).groupBy("task").count()) == sorted([(None, 4), ("t", 4)], key=repr)


@pytest.mark.parametrize("n", [0, 1, 5, 7, 11, 30, 99])
def test_prefixes_are_exact_on_equal_keys(spark, n):
    df = pairs(spark, 30).repartition(4).withColumns(
        {"task": F.when(F.col("ex_id") < 20, "t"), "split_rank": F.lit(0), "ord": F.floor(F.col("ex_id") / 10)}
    )
    df = df.withColumn("ord", F.when(F.col("ord") > 0, F.col("ord")))
    first = curate.first_n(df, n)
    assert first.columns == df.columns and first.distinct().count() == min(n, 30)
    assert first.where("ord is null").count() == min(n, 10)
    got = dict(rows(curate.sample_per_task(df, n).groupBy("task").count()))
    assert got == ({"t": min(n, 20), None: min(n, 10)} if n else {})


def test_split_moves_no_rows(spark):
    text = plan(split.exact_split(pairs(spark, 100)))
    assert "Exchange hashpartitioning" not in text and "Window" not in text


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 10).alias("v")
    )
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert rows(hot_keys(big, ["k"], 500)) == [(1, 3)]
    assert rows(salted_join(big, small, ["k"], how, 500)) == rows(big.join(small, ["k"], how))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_both_ways_of_a_lookup_agree_with_null_keys(spark, how, null_safe):
    big = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("k"), (F.col("id") % 7).alias("v"))
    small = spark.createDataFrame([(None, 5), (1, 6), (2, 7)], "k long, w int")
    one = lookup_join(big, small, ["k"], how, null_safe=null_safe)
    two = lookup_join(big, small, ["k"], how, max_rows=0, null_safe=null_safe)
    three = salted_join(big, small, ["k"], how, 100, null_safe=null_safe)
    assert one.columns == two.columns == three.columns == ["k", "v", "w"]
    assert rows(one) == rows(two) == rows(three)
    want = sum(((k is None and null_safe) or k in (1, 2)) or how == "left" for k, _ in rows(big))
    assert one.count() == want


def test_null_and_heavy_keys_spread(spark, monkeypatch):
    big = spark.range(400).select(
        F.when(F.col("id") < 300, F.col("id")).alias("k"),
        F.when(F.col("id") == 7, F.repeat(F.lit("x"), 1000)).otherwise("y").alias("text"),
    )
    assert rows(hot_keys(big, ["k"], 25)) == [(None, 4)]
    monkeypatch.setattr("pairloom.operators.joins.HOT_BYTES", 950)
    assert dict(rows(hot_keys(big, ["k"], 1000))).keys() == {7}
    joined = salted_join(big, spark.createDataFrame([(1, 1)], "k long, w int"), ["k"], "left", 25)
    used = joined.where("k is null").select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_hot_keys_are_relative_to_the_table(spark, monkeypatch):
    monkeypatch.setattr("pairloom.operators.joins.HOT_ROWS", 10)
    df = spark.range(3200).select(F.when(F.col("id") < 1100, 0).otherwise(F.col("id")).alias("k"))
    # More than 3200 / (4 * 4 partitions) rows.
    assert rows(hot_keys(df, ["k"])) == [(0, 6)]
