import random

import numpy as np
import pytest
from conftest import rows

from pairloom.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int, row string, block int, score long"


def vectors(seed, n=300, dims=20, labels=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims)) / 3 + rng.normal(size=(labels, dims))[rng.integers(0, labels, n)]
    base[: n // 3] = base[0]  # a third of all rows is one vector
    return [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, labels)), "r", 0, 1) for i, v in enumerate(base)]


def brute(data, positives=5, negatives=10, every=10):
    usable = [
        (i, [int(np.floor(256 * np.float64(c))) for c in v], label)
        for i, v, label, *_ in data
        if i is not None and label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)
    ]
    out = []
    for k, (a, q, label) in enumerate(usable):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=False)), i, o == label) for j, (i, v, o) in enumerate(usable) if j != k]
        scored.sort()
        for p, i, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(fit[:negatives])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_over_several_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(hard, "BLOCK", 32)
    monkeypatch.setattr(hard, "ANCHORS", 4)
    monkeypatch.setattr(hard, "ROUND", 8)
    data = vectors(seed)
    random.Random(seed).shuffle(data)
    got = hard.hard_negatives(spark.createDataFrame(data, SCHEMA).repartition(3), "vec_id % 10 = 0")
    assert rows(got) == brute(data)


def test_scores_are_inner_products():
    rng = np.random.default_rng(3)
    for dims, low, high in ((1, -1, 2), (8, -300, 300), (13, 0, 1), (64, -(2**24), 2**24), (5, -256, 0)):
        a, c = rng.integers(low, high, (7, dims)), rng.integers(low, high, (11, dims))
        assert np.array_equal(hard.scores(hard.bit_planes(c), hard.subset_sums(a)), c @ a.T)


def test_order_of_ties_and_of_wide_scores():
    ids = np.arange(6) * 10
    for top in (7, 1 << 61):
        score = np.array([[top, 1], [top, hard._LOW], [-top, 1], [hard._LOW, 0], [3, 1], [top, 5]])
        found, who = hard._first(score, ids, 4)
        assert found.tolist() == [[top, top, top, 3], [5, 1, 1, 1]]
        assert who.tolist() == [[0, 10, 50, 40], [50, 0, 20, 40]]


def test_odd_rows(spark):
    data = vectors(5, n=40) + [
        (None, [1.0] * 20, 1, None, None, None),
        (1000, None, 1, None, None, None),
        (1010, [1.0] * 20, None, None, None, None),
        (1020, [None] + [1.0] * 19, 1, None, None, None),
        (1030, [float("nan")] * 20, 1, None, None, None),
        (1040, [float("inf")] * 20, 1, None, None, None),
        (1050, [0.0] * 20, 1, None, None, None),
        (1060, [], 1, None, None, None),
        (1070, [0.5] * 30, 2, None, None, None),
        (1080, [0.5], 2, None, None, None),
        (1090, [0.5] * 20, 9, None, None, None),
        (1100, [-0.5] * 20, 1, None, None, None),
    ]
    assert rows(hard.hard_negatives(spark.createDataFrame(data, SCHEMA), "vec_id % 10 = 0")) == brute(data)
    # Rows that repeat, id and all, are rows of their own; one never is its own positive.
    twice = vectors(6, n=30) * 2
    got = hard.hard_negatives(spark.createDataFrame(twice, SCHEMA), "vec_id % 10 = 0")
    assert rows(got) == brute(twice)
    assert hard.hard_negatives(spark.createDataFrame([], SCHEMA), "vec_id % 10 = 0").count() == 0
    assert hard.hard_negatives(spark.createDataFrame(data, SCHEMA), "vec_id < 0").count() == 0
