import numpy as np
import pytest

from pairloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, part int, x string, dims int"


def spread_vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dims)) @ (rng.normal(size=(dims, dims)) * (0.95 ** np.arange(dims))[:, None]) + 3


def table(spark, data):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v)), 0, 1, "c", 2) for i, v in data], SCHEMA)


@pytest.mark.parametrize(("n", "dims", "k"), [(400, 40, 32), (200, 5, 32), (90, 12, 4)])
def test_equals_dense_eigenvectors(spark, n, dims, k):
    v = spread_vectors(n, n, dims)
    got = whitening.whitened(table(spark, list(enumerate(v))).repartition(5), k).toPandas()
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    s = x.sum(axis=0)
    y = (n * x - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert len(got) == n * min(k, dims) and set(got.n) == {n}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = y @ vectors / np.sqrt(values)
    sign = np.sign((wide * want).sum(axis=0))
    assert np.abs(wide - want * sign).max() < 1e-8
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-8
    explained = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, values / (y * y).sum() * n, rtol=1e-10)
    exact = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for i, r in enumerate(x)}
    assert {(i, d) for i, d in zip(got.vec_id, got.deviation, strict=True)} == set(exact.items())


@pytest.mark.parametrize("case", ["random", "equal", "pairs", "blocks", "one", "zero", "rank"])
def test_solver(case):
    rng = np.random.default_rng(4)
    n = 1 if case == "one" else 30
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = np.ones(1) if n == 1 else {
        "random": rng.random(n),
        "equal": np.full(n, 2.0),
        "pairs": np.repeat(np.arange(1, n // 2 + 1), 2).astype(float),
        "blocks": np.repeat([1.0, 1.0 + 1e-13, 5.0], n // 3),
        "zero": np.zeros(n),
        "rank": np.concatenate([[3.0, 2.0], np.zeros(n - 2)]),
    }[case]
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.principal(matrix, 12)
    want = np.sort(values)[::-1][:12]
    want = want[want > 1e-12]
    assert np.allclose(found, want, rtol=1e-12, atol=1e-13)
    assert np.abs(matrix @ vectors - vectors * found).max(initial=0.0) < 1e-12 * max(values.max(), 1)
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max(initial=0.0) < 1e-12
    diagonal, off, _ = whitening.tridiagonal(matrix)
    at = np.array([-1.0, 0.5, 2.5, 100.0])
    counts = whitening.sturm_counts(diagonal, off, at)
    sure = np.abs(values[:, None] - at).min(axis=0) > 1e-9
    assert (counts == (values[:, None] < at).sum(axis=0))[sure].all()


def test_odd_rows(spark):
    v = spread_vectors(1, 60, 6)
    odd = [(900, None), (901, [float("nan")] * 6), (902, [float("inf")] * 6), (903, []), (904, [1e300] * 6)]
    odd += [(None, v[0]), (7, v[1]), (7, v[1])]
    lone = [(i, spread_vectors(2, 20, 3)[i - 2000]) for i in range(2000, 2020)] + [(3000, [1.0, 2.0])]
    docs = table(spark, [*enumerate(v), *odd, *lone])
    got = whitening.whitened(docs.union(spark.createDataFrame([(905, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 0, 0, "", 0)], SCHEMA))).toPandas()
    assert not set(got.vec_id.dropna()) & {900, 901, 902, 903, 904, 905, 3000}
    of = got[got.component == 1]
    assert (of.vec_id == 7).sum() == 3 and of.vec_id.isna().sum() == 1
    # Each length is a fit of its own.
    assert set(of[of.vec_id.between(2000, 2019)].n) == {20} and set(of[of.vec_id == 7].n) == {63}
    assert (got.identity_error < 1e-8).all()
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0


def test_deviations_beyond_long():
    big = np.array([[3 << 30, 1], [1, 2]], np.int64)
    assert whitening._square_sums(big) == [(3 << 30) ** 2 + 1 if (3 << 30) ** 2 + 1 < 1 << 63 else None, 5]
    assert whitening._square_sums(np.array([[1 << 31, 1], [1 << 32, 0]], np.int64)) == [(1 << 62) + 1, None]
