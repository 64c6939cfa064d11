import numpy as np
import odd_documents as odd
import pytest

from pairloom.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, n long, digest string"


def vectors(n=400, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    near = centres[rng.integers(0, 12, n // 2)] + rng.normal(size=(n // 2, dims)) * 0.2
    x = np.concatenate([near, rng.normal(size=(n - n // 2, dims)), near[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), 0, 1, "d") for i, v in enumerate(x)]
    rows += [
        (900, None, 0, None, None), (901, [0.0] * dims, 0, 1, ""), (902, [None] + [1.0] * (dims - 1), 0, 1, ""),
        (903, [float("nan")] + [1.0] * (dims - 1), 0, 1, ""), (904, [float("inf")] + [1.0] * (dims - 1), 0, 1, ""),
        (905, [], 0, 1, ""), (None, x[0].tolist(), 0, 1, ""), (3, x[3].tolist(), 0, 1, ""), (906, [1.0], 0, 1, ""),
    ]
    return rows


def several_lengths(seed=3):
    """Lengths with many and with few vectors, equal and near ones among them."""
    rng = np.random.default_rng(seed)
    out = vectors(200, 16, seed)
    for dims, n in ((1, 6), (3, 90), (8, 30), (2, 2)):
        x = rng.normal(size=(n, dims)).astype(np.float32)
        x[n // 2 :] = x[: n - n // 2] * 2
        out += [(10_000 * dims + i, v.tolist(), 0, 1, "") for i, v in enumerate(x)]
    return out


def brute(rows, threshold=0.9):
    units = {}
    for i, (vec_id, v, *_) in enumerate(rows):
        if vec_id is not None and v and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and np.any(x):
                units[i] = x / np.linalg.norm(x)
    usable = list(units)
    near = np.array([[len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold for b in usable] for a in usable])
    root = odd.components(len(usable), lambda a, b: near[a, b])
    smallest = {}
    for r, i in zip(root, usable, strict=True):
        smallest[r] = min(smallest.get(r, rows[i][0]), rows[i][0])
    found = {i: (int(near[k].sum()) - 1, smallest[root[k]]) for k, i in enumerate(usable)}
    out = []
    for i, (vec_id, *_) in enumerate(rows):
        links, component = found.get(i, (0, vec_id))
        out.append((vec_id, links, component, vec_id is not None and vec_id == component))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [0, 40, 1024])
def test_every_length_is_linked(spark, few, monkeypatch):
    monkeypatch.setattr(multi_index, "CELL", 8)
    monkeypatch.setattr(multi_index, "FEW", few)
    rows = several_lengths()
    got = multi_index.near_duplicates(spark.createDataFrame(rows, SCHEMA), recall=1.0).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("cell, block", [(8, 1024), (8, 3), (2, 5), (1, 40), (1000, 16)])
def test_whole_recall_equals_brute_force(spark, cell, block, monkeypatch):
    monkeypatch.setattr(multi_index, "CELL", cell)
    monkeypatch.setattr(multi_index, "BLOCK", block)
    monkeypatch.setattr(multi_index, "FEW", 0)
    rows = vectors()
    got = multi_index.near_duplicates(spark.createDataFrame(rows, SCHEMA), recall=1.0).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_tiles_and_bits_name_the_visited_cells():
    rng = np.random.default_rng(2)
    for k in (1, 7, 8, 9, 20):
        cells = np.array([rng.permutation(k * k)[: min(k * k, 12)] for _ in range(30)])
        row, tile, mask = multi_index.masks(cells, k)
        assert len(set(zip(row.tolist(), tile.tolist(), strict=True))) == len(row)
        named = [set() for _ in cells]
        place = dict(zip(zip(*(x.tolist() for x in multi_index.tiles_of(np.arange(k * k), k)), strict=True), range(k * k), strict=True))
        for r, t, m in zip(row, tile.tolist(), mask.view(np.uint64).tolist(), strict=True):
            named[r] |= {place[t, s] for s in range(64) if m >> s & 1}
        assert named == [set(c.tolist()) for c in cells]
        codes = rng.normal(size=(k, 5))
        ordered = multi_index.neighbours_first(codes)
        assert sorted(map(tuple, ordered)) == sorted(map(tuple, codes))


def test_recall_of_links(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CELL", 8)
    monkeypatch.setattr(multi_index, "FEW", 0)
    rows = vectors(1000, 32, 5)
    want = {r[0]: r[1] for r in brute(rows) if r[0] is not None}
    got = {r.vec_id: r.n_links for r in multi_index.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got[i] for i in want) >= 0.95 * sum(want.values()) > 0


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    books = rng.normal(size=(7, 4)), rng.normal(size=(7, 4))
    x = rng.normal(size=(20, 8))
    d1, d2 = multi_index.distances(x[:, :4], books[0]), multi_index.distances(x[:, 4:], books[1])
    order = np.argsort((d1[:, :, None] + d2[:, None, :]).reshape(20, -1), axis=1, kind="stable")
    for cells in (1, 2, 5, 20, 49):
        assert (multi_index.visited(x, books, cells) == order[:, :cells]).all()


def test_small_and_empty_tables(spark):
    assert multi_index.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(1, [1.0, 0.0], 0, 1, "")], [(2, [1.0, 0.0], 0, 1, ""), (1, [2.0, 0.0], 0, 1, "")], [(1, None, 0, 1, "")], [(1, [3.0], 0, 1, ""), (2, [4.0], 0, 1, "")]):
        got = multi_index.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
