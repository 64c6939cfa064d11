"""Near duplicates of vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, span a grid of cells. Every distinct vector is
stored in its nearest cell and, as a query, visits the cells that the multi-sequence order brings
first: by rising sum of its two distances. How many it visits is set on the sample so that a
neighbour at the threshold is found, from either side, with probability ``recall``. A pair that
shares a visited cell is verified by its cosine in double precision; none below the threshold links.

Codes are numbered so that neighbours follow each other, and ``SIDE`` by ``SIDE`` cells make a tile. A
task has the stored vectors of a tile; a vector is sent once to each other tile with cells that it
visits, with a bit for each of them, and meets the cells of its own tile where it is stored.

Codebooks are fitted on a bounded sample (about ``SAMPLE`` vectors of a length at most, a documented
bound); every vector is indexed. Their size follows the number of vectors, so a cell holds about ``CELL`` on
average and the work grows in proportion. Equal vectors are one class and are never paired. Tiles
over ``BLOCK`` vectors are dealt to blocks, and queries meet the blocks one by one; tasks return sums
of links and a spanning forest, never all pairs.

Vectors are compared with those of their length. Each length has codebooks of its own; a length with
at most ``FEW`` distinct vectors is one cell, in which all are compared.

Null and zero vectors, vectors with null or non-finite components and rows without an id link with
nothing. Rows with equal ids count as vectors.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import Forest, components
from pairloom.llm.words import small
from pairloom.storage import materialise

THRESHOLD = 0.9
RECALL = 0.99
SAMPLE = 32_768
CELL = 128
MOST_CODES = 1_024
# Cells of a tile have a bit each in a long.
SIDE = 8
BLOCK = 16_384
FEW = 1_024
_TRIALS = 2_000
# Distances that a step holds at once.
_HELD = 1 << 22
# Queries that a step meets with a tile.
_STEP = 4_096


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), np.finfo(np.float64).tiny)[:, None]


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * x @ codes.T + (codes * codes).sum(axis=1), 0.0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of k-means from evenly spaced starting rows; empty clusters keep their centre."""
    codes = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(p, codes).argmin(axis=1) for p in _parts(x, k)])
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        full = count > 0
        codes[full] = sums[full] / count[full][:, None]
    return codes


def neighbours_first(codes: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The codes in an order in which runs of ``side`` are near each other: halved along their widest direction."""
    if len(codes) <= side or not codes.shape[1]:
        return codes
    centred = codes - codes.mean(axis=0)
    direction = np.linalg.svd(centred, full_matrices=False)[2][0]
    order = np.argsort(centred @ direction, kind="stable")
    cut = max(len(codes) // (2 * side), 1) * side
    return np.concatenate([neighbours_first(codes[order[:cut]], side), neighbours_first(codes[order[cut:]], side)])


def _parts(x: np.ndarray, width: int) -> Iterator[np.ndarray]:
    step = max(_HELD // max(width, 1), 1)
    for i in range(0, len(x), step):
        yield x[i : i + step]


def visited(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cells: int) -> np.ndarray:
    """The first ``cells`` cells of each row in multi-sequence order.

    The cell at places (a, b) of the two sorted sequences has (a + 1)(b + 1) - 1 cells before it, so
    only places whose product is at most ``cells`` can be among the first.
    """
    half = x.shape[1] // 2
    k = len(books[0])
    places = np.array([(a, b) for a in range(min(k, cells)) for b in range(min(k, cells // (a + 1)))])
    out = []
    for part in _parts(x, max(k, len(places))):
        ranked = []
        for block, codes in zip((part[:, :half], part[:, half:]), books, strict=True):
            d = distances(block, codes)
            order = np.argsort(d, axis=1, kind="stable")[:, : min(k, cells)]
            ranked.append((order, np.take_along_axis(d, order, axis=1)))
        (o1, d1), (o2, d2) = ranked
        total = d1[:, places[:, 0]] + d2[:, places[:, 1]]
        first = np.argsort(total, axis=1, kind="stable")[:, :cells]
        out.append(np.take_along_axis(o1, places[first, 0], axis=1) * k + np.take_along_axis(o2, places[first, 1], axis=1))
    return np.concatenate(out) if out else np.zeros((0, cells), np.int64)


def cells_to_visit(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float) -> int:
    """Cells until a neighbour at the threshold is met from one side or the other with ``recall``."""
    rng = np.random.default_rng(0)
    x = x[rng.permutation(len(x))[:_TRIALS]]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1)[:, None] * x
    y = threshold * x + np.sqrt(1 - threshold**2) * unit(noise)
    half = x.shape[1] // 2

    def sums(v):
        return [distances(v[:, :half], books[0]), distances(v[:, half:], books[1])]

    (x1, x2), (y1, y2) = sums(x), sums(y)

    def rank(d1, d2, e1, e2):
        """Cells that come before the other vector's own cell."""
        limit = np.take_along_axis(d1, e1.argmin(axis=1)[:, None], 1) + np.take_along_axis(d2, e2.argmin(axis=1)[:, None], 1)
        return np.array([(a[:, None] + b[None, :] < t).sum() for a, b, t in zip(d1, d2, limit, strict=True)])

    before = np.minimum(rank(x1, x2, y1, y2), rank(y1, y2, x1, x2))
    return int(min(np.quantile(before, recall, method="higher") + 1, len(books[0]) ** 2))


def tiles_of(cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tile of every cell of a grid of ``k`` by ``k``, and the cell's place in its tile."""
    a, b = cells // k, cells % k
    return a // SIDE * -(-k // SIDE) + b // SIDE, a % SIDE * SIDE + b % SIDE


def masks(cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, tiles and bits of the cells that each row of ``cells`` names: one entry for a row and tile."""
    tile, spot = tiles_of(cells, k)
    row = np.repeat(np.arange(len(cells)), cells.shape[1])
    order = np.lexsort((tile.ravel(), row))
    row, tile = row[order], tile.ravel()[order]
    begin = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(tile) != 0)]) if len(row) else np.zeros(0, np.int64)
    bits = np.left_shift(np.uint64(1), spot.ravel()[order].astype(np.uint64))
    return row[begin], tile[begin], np.bitwise_or.reduceat(bits, begin).view(np.int64) if len(row) else bits.view(np.int64)


class _Rows(NamedTuple):
    """Vectors of one tile and block: stored ones, or queries from elsewhere."""

    ids: np.ndarray
    n: np.ndarray
    unit: np.ndarray
    home: np.ndarray
    spot: np.ndarray
    mask: np.ndarray
    visits: np.ndarray | None

    def at(self, place: np.ndarray) -> "_Rows":
        return _Rows(*(None if x is None else x[place] for x in self))


def _verified(kind: str, threshold: float):
    """Tasks over rows sorted by tile, block and kind: stored vectors first, then queries."""

    def unpack(rows: pa.RecordBatch, stored: bool) -> _Rows:
        ids, n, home, spot = (rows.column(k).to_numpy() for k in (3, 4, 6, 7))
        raw = np.frombuffer(b"".join(rows.column(5).to_pylist()), kind).reshape(len(rows), -1)
        visits = np.frombuffer(b"".join(rows.column(9).to_pylist()), "<i4").reshape(len(rows), -1) if stored else None
        return _Rows(ids, n, unit(raw), home, spot, rows.column(8).to_numpy().view(np.uint64), visits)

    def sums(ids: np.ndarray, counts: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        linked, moved = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(root)))
        a = np.concatenate([ids[linked], ids[moved]])
        b = np.concatenate([ids[linked], ids[root[moved]]])
        links = np.concatenate([counts[linked], np.zeros(len(moved), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(links)], ["a", "b", "links"])

    def pairs(one: _Rows, other: _Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(_HELD // max(len(other.ids), 1), 1)
        for lo in range(0, len(one.ids), step):
            i, j = np.nonzero(one.unit[lo : lo + step] @ other.unit.T >= threshold)
            yield i + lo, j

    def across(query: _Rows, stored: _Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in pairs(query, stored):
            home = query.home[i]
            # A pair whose other end visits back is counted in the smaller of the two cells.
            back = (home < stored.home[j]) & (stored.visits[j] == home[:, None]).any(axis=1)
            yield i[~back], j[~back]

    def visiting(rows: _Rows, spot: int, home_too: bool) -> np.ndarray:
        named = (rows.mask >> np.uint64(spot)) & np.uint64(1) == 1
        return np.flatnonzero(named if home_too else named & (rows.spot != spot))

    def within(tile: _Rows, cells: dict[int, np.ndarray]) -> pa.RecordBatch:
        """Links among the stored vectors of a tile."""
        counts, forest = np.zeros(len(tile.ids), np.int64), Forest(len(tile.ids))

        def add(i: np.ndarray, j: np.ndarray) -> None:
            np.add.at(counts, i, tile.n[j])
            np.add.at(counts, j, tile.n[i])
            forest.link(i, j)

        for spot, members in cells.items():
            own = tile.at(members)
            for i, j in pairs(own, own):
                add(members[i[i < j]], members[j[i < j]])
            guests = visiting(tile, spot, False)
            for i, j in across(tile.at(guests), own):
                add(guests[i], members[j])
        return sums(tile.ids, counts, forest.root)

    def met(query: _Rows, tile: _Rows, cells: dict[int, np.ndarray]) -> pa.RecordBatch:
        """Links of queries from elsewhere with the stored vectors of a tile."""
        ids = np.concatenate([tile.ids, query.ids])
        counts, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for spot, members in cells.items():
            guests = visiting(query, spot, True)
            for i, j in across(query.at(guests), tile.at(members)):
                i, j = guests[i], members[j]
                np.add.at(counts, j, query.n[i])
                np.add.at(counts, i + len(tile.ids), tile.n[j])
                forest.link(i + len(tile.ids), j)
        return sums(ids, counts, forest.root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, tile, cells = None, [], None, {}

        def whole() -> tuple[_Rows, dict[int, np.ndarray]]:
            rows = _Rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return rows, {s: np.flatnonzero(rows.spot == s) for s in np.unique(rows.spot).tolist()}

        for batch in batches:
            place, block, query = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(block) != 0) | (np.diff(query) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if (place[lo], block[lo]) != key:
                    if parts and tile is None:
                        yield within(*whole())
                    key, parts, tile = (place[lo], block[lo]), [], None
                rows = batch.slice(lo, hi - lo)
                if not query[lo]:
                    parts.append(unpack(rows, True))
                elif parts:
                    if tile is None:
                        tile, cells = whole()
                        yield within(tile, cells)
                    for at in range(0, len(rows), _STEP):
                        yield met(unpack(rows.slice(at, _STEP), False), tile, cells)
        if parts and tile is None:
            yield within(*whole())

    return run


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Rows with a digest (null if the vector links with nothing), one row per distinct vector, and its format."""
    kind = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v in batch.column(1).to_pylist():
                x = np.array(v, kind) if v is not None and None not in v else None
                usable = x is not None and np.isfinite(x).all() and np.any(x)
                raw.append(x.tobytes() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, vec binary")
    rows = rows.withColumn("vec", F.when(F.col("vec_id").isNotNull(), F.col("vec")))
    rows = materialise(rows.withColumn("digest", F.sha2("vec", 256)))
    classes = rows.where("vec is not null").groupBy("digest").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")
    )
    classes = classes.withColumn("dims", F.expr(f"octet_length(vec) div {np.dtype(kind).itemsize}"))
    return rows.select("vec_id", "digest"), materialise(classes), kind


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row."""
    rows, classes, kind = _classes(vectors)
    plans = _plans(classes, kind, threshold, recall)
    found = materialise(_search(classes, kind, plans, threshold))
    links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("links = 0"))
    named = (
        classes.select("digest", "first", "n")
        .join(links, classes["first"] == links["a"], "left")
        .join(roots, classes["first"] == roots["node"], "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "first").alias("component_id"))
    )
    out = rows.join(named, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _plans(classes: DataFrame, kind: str, threshold: float, recall: float) -> dict[int, tuple]:
    """Codebooks and cells to visit for every length with more than ``FEW`` distinct vectors."""
    sizes = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).collect()}
    plans = {}
    for dims, n in sorted(sizes.items()):
        share = int(min(1.0, SAMPLE / n) * (1 << 30))
        drawn = classes.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < share))
        picked = sorted((r["first"], bytes(r["vec"])) for r in drawn.select("first", "vec").collect())
        x = unit(np.frombuffer(b"".join(v for _, v in picked), kind).reshape(len(picked), dims))
        k = int(min(np.clip(np.ceil(np.sqrt(n / CELL)), 1, MOST_CODES), len(picked)))
        halves = x[:, : dims // 2], x[:, dims // 2 :]
        books = tuple(neighbours_first(codebook(half, k)) for half in halves)
        plans[dims] = (books, cells_to_visit(x, books, threshold, recall))
    return plans


def _search(classes: DataFrame, kind: str, plans: dict[int, tuple], threshold: float) -> DataFrame:
    """``a``, ``b``, ``links``: numbers of links where ``links`` > 0, spanning links where it is 0."""
    size = np.dtype(kind).itemsize

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            lengths = np.array([len(v) // size for v in vectors])
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                cell, k = np.zeros((len(at), 1), np.int64), 1
                if dims in plans:
                    x = unit(np.frombuffer(b"".join(vectors[i] for i in at), kind).reshape(len(at), dims))
                    cell, k = visited(x, *plans[dims]).astype(np.int64), len(plans[dims][0][0])
                home, spot = tiles_of(cell[:, 0], k)
                row, tile, mask = masks(cell, k)
                own = tile == home[row]
                # The length is part of the tile, so no two lengths meet.
                tile = tile + dims * MOST_CODES**2
                count = np.bincount(row[~own], minlength=len(at))
                other = pa.StructArray.from_arrays([pa.array(tile[~own]), pa.array(mask[~own])], ["tile", "mask"])
                others = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), other)
                visits = pa.array([v.tobytes() for v in cell.astype("<i4")], pa.binary())
                found = [pa.array(tile[own]), pa.array(cell[:, 0].astype(np.int32)), pa.array(spot.astype(np.int8)), pa.array(mask[own])]
                columns = [*batch.take(pa.array(at)).columns, *found, visits, others]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "tile", "home", "spot", "mask", "visits", "others"])

    placed = classes.select(F.col("first").alias("id"), "n", "vec").mapInArrow(
        assign,
        "id long, n long, vec binary, tile long, home int, spot byte, mask long, visits binary, others array<struct<tile: long, mask: long>>",
    )
    placed = materialise(placed)
    large = placed.groupBy("tile").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK)
    blocks = small(materialise(large.select("tile", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))))
    count = F.coalesce("blocks", F.lit(1))
    every = F.explode(F.sequence(F.lit(0), count - 1))
    stored = placed.join(blocks, "tile", "left").withColumn("block", F.pmod(F.xxhash64("id"), count).cast("int"))
    # To the other blocks of its tile a vector goes for the cells it visits, for its own cell to those before.
    own = stored.where("blocks > 1").withColumn("to", every).where("to <> block")
    besides = F.col("mask").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, spot)")))
    own = own.withColumn("mask", F.when(F.col("to") < F.col("block"), F.col("mask")).otherwise(besides)).where("mask <> 0")
    own = own.withColumn("block", F.col("to"))
    sent = placed.select("id", "n", "vec", "home", "spot", F.inline("others"))
    sent = sent.join(blocks, "tile", "left").withColumn("block", every)
    columns = ["tile", "block", "query", "id", "n", "vec", "home", "spot", "mask", "visits"]
    none = F.lit(None).cast("binary")
    queries = [q.withColumn("query", F.lit(1)).withColumn("visits", none).select(columns) for q in (own, sent)]
    dealt = stored.withColumn("query", F.lit(0)).select(columns).unionByName(queries[0]).unionByName(queries[1])
    dealt = dealt.repartition("tile", "block").sortWithinPartitions("tile", "block", "query")
    return dealt.mapInArrow(_verified(kind, threshold), "a long, b long, links long")
