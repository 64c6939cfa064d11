import hashlib
import math

import odd_documents as odd
import pytest
from pyspark.sql import functions as F

from pairloom.llm import mixing


def brute_targets(sizes, weights=(3.0, 1.0, 2.0), budget=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = budget * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def brute(data):
    docs = []
    for d in data:
        text = d[1] or ""
        size = len(odd.space_words(text))
        q = max(size, 1) / (size + 20) / (1 + abs(len(text) / max(size, 1) - 6) / 6)
        h = hashlib.md5(text.encode()).hexdigest()
        u = (int(hashlib.md5(f"mix:{'' if d[0] is None else d[0]}:{h}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        docs.append((d[3], size, -math.log(u) / q, d[0]))
    sizes = {}
    for source, size, *_ in docs:
        sizes[source] = sizes.get(source, 0) + size
    targets = brute_targets(sizes)
    out = []
    for source, total in sizes.items():
        epochs = int(targets[source] // total) if total else 0
        rest, done = targets[source] - epochs * total, 0
        for _, size, _, doc_id in sorted((d for d in docs if d[0] == source), key=lambda d: d[2]):
            done += size
            out.append((doc_id, source, size, total, round(targets[source], 6), size * (epochs + (done - size / 2 <= rest))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mix_equals_brute_force(spark, seed):
    data = odd.rows(seed)
    got = mixing.mix(spark.createDataFrame(data, odd.SCHEMA).repartition(3))
    found = [(r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in got.collect()]
    assert sorted(found, key=repr) == brute(data)
    assert all(r[5] <= 2 * r[2] for r in found)


def test_targets_share_again_until_none_is_over(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 7, "e": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_many_sources_are_ranked_in_ranges(spark):
    sizes = {f"host{i * 7919 % 5003}": (i * 37) % 211 for i in range(3_000)} | {None: 50}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    targets = mixing.source_targets(df)
    want = brute_targets(sizes)
    got = {r.source: r.target for r in targets.collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    ranged = mixing.in_order(df, F.col("source").asc_nulls_last())
    parts = {r.part: r.n for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(parts) > 1 and max(parts.values()) < len(sizes)


def test_taken_words_come_near_the_target(spark):
    rows = [(i, "word " * (i % 40), "en", f"s{i % 4}", 1, None, None, None) for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, odd.SCHEMA)).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 40 for r in got)


def test_quality_orders_the_fractional_part(spark):
    rows = [(i, "word " * 10, "en", "a", 1, w, None, None) for i in range(300) for w in ([1.0, 1e6, None, -1.0, float("nan")][i % 5],)]
    got = mixing.mix(spark.createDataFrame(rows, odd.SCHEMA), quality=F.col("score"), budget=0.2).collect()
    assert len(got) == 300 and {r.doc_id % 5 for r in got if r.taken} == {1}
    got = mixing.mix(spark.createDataFrame(rows, odd.SCHEMA), quality=F.col("score"), budget=0.5).collect()
    assert {r.doc_id % 5 for r in got if r.taken} >= {0, 1} and all(r.taken for r in got if r.doc_id % 5 < 2)


def test_empty_table(spark):
    assert mixing.mix(odd.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "en", "a", 0, None, None, None)], odd.SCHEMA)
    assert mixing.mix(nothing).first().taken == 0
