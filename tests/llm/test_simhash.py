import os
from collections import Counter

import numpy as np
import odd_documents as odd
import pytest
import xxhash
from conftest import rows
from pyspark.sql import functions as F

from pairloom.llm import simhash
from pairloom.llm.components import Forest
from pairloom.storage import materialise


def brute_fingerprint(text):
    words = [odd.lower(w) for w in odd.space_words(text)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_brute_force_and_jvm_hash(spark):
    for text in (None, "", "a", "A b", "A B c", "É e\tf g a b c d", *[r[1] for r in odd.rows(1, 20)[:30]]):
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    jvm = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert jvm & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42) == simhash.fingerprint("a b c")


def close_values(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n // 10 + 1).astype(np.uint64)
    v = base[rng.integers(0, len(base), n)]
    for _ in range(5):
        v = v ^ np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(v)


@pytest.mark.parametrize("leaf", [2, 7, 2048])
def test_links_span_the_components(spark, leaf):
    v = close_values(leaf, 300)
    prints = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    links = simhash.linked(prints, leaf).collect()
    place = {int(x): i for i, x in enumerate(v.view(np.int64))}
    for a, b in links:
        assert int(v[place[a]] ^ v[place[b]]).bit_count() <= 3 or leaf  # a forest names roots, not links
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    want = odd.components(len(v), lambda i, j: near[i, j])
    joined = {(place[a], place[b]) for a, b in links}
    got = odd.components(len(v), lambda i, j: (i, j) in joined or (j, i) in joined)
    assert got == want


@pytest.mark.parametrize(
    "read",
    [
        {},
        {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.5",
        },
    ],
    ids=["broadcast", "skew"],
)
def test_links_span_the_components_however_tries_are_spread(spark, read):
    """Small tables end in one partition; larger ones do not, and a join on the way may be read in other parts."""
    held = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", **read}
    before = {k: spark.conf.get(k, None) for k in held}
    v = close_values(7, 4000)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    try:
        for k, x in held.items():
            spark.conf.set(k, x)
        prints = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long").repartition(8)
        links = simhash.linked(materialise(prints), 128).collect()
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    place = {int(x): i for i, x in enumerate(v.view(np.int64))}
    got, want = Forest(len(v)), Forest(len(v))
    got.link(np.array([place[a] for a, _ in links]), np.array([place[b] for _, b in links]))
    want.link(*np.nonzero(near))
    assert got.root.tolist() == want.root.tolist()


def test_documents_equal_brute_force(spark):
    data = [r for r in odd.rows(2) if r[0] is not None]
    prints = [brute_fingerprint(r[1]) for r in data]
    root = odd.components(len(data), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    smallest = {}
    for r, d in zip(root, data, strict=True):
        smallest[r] = min(smallest.get(r, d[0]), d[0])
    want = [(d[0], p, smallest[r]) for d, p, r in zip(data, prints, root, strict=True)]
    got = simhash.near_duplicates(spark.createDataFrame(data, odd.SCHEMA))
    assert sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got.collect()) == sorted(want)


def test_null_ids_and_empty_table(spark):
    got = simhash.near_duplicates(odd.documents(spark)).where("doc_id is null").collect()
    assert len(got) == 2
    # The null text links to the empty texts, whose smallest id is 200.
    assert {r.component_id for r in got if r.fp == 0} == {200}
    assert simhash.near_duplicates(odd.empty(spark)).count() == 0
    assert simhash.distinct_documents(odd.empty(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = odd.documents(spark, 4)
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs)
    # The two texts of id 208 are two groups.
    groups = [*{r.component_id for r in found.collect()}, 208]
    assert sorted(map(repr, groups)) == sorted(repr(r.doc_id) for r in kept.collect())
    assert set(rows(kept)) <= set(rows(docs))


def test_columns_with_names_of_the_operators_own(spark):
    data = [(1, "a b c d", 1, 2, 3, 4), (1, "a b c d", 5, 6, 7, 8), (2, "a b c d", 1, 1, 1, 1), (3, "x", 0, 0, 0, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, kept int, _KEPT int, fp int, component_id int")
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_tries_of_documents_are_split_and_pruned(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(path).repartition(4)
    v = np.array(sorted({r.fp & (2**64 - 1) for r in docs.select(simhash.fingerprints("text").alias("fp")).collect()}), np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= simhash.BUDGET
    ones = np.array([0]), np.array([len(v)])
    for agreed in (0, simhash.BLOCK_BITS):
        seen = Counter()
        root = simhash.trie_links(v, *ones, *ones, agreed, seen)
        assert seen["split"] > len(v) and seen["pruned"] > 100
        if not agreed:
            assert root.tolist() == odd.components(len(v), lambda i, j: near[i, j])
    # Dealt by a few bits and rotated four times, all links come out too.
    found = simhash.linked(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long"), 64).collect()
    place = {int(x): i for i, x in enumerate(v.view(np.int64))}
    joined = {(place[a], place[b]) for a, b in found}
    assert odd.components(len(v), lambda i, j: (i, j) in joined or (j, i) in joined) == root_of(v, near)


def root_of(v, near):
    return odd.components(len(v), lambda i, j: near[i, j])
