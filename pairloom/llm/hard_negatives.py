"""Hard negatives for contrastive training, scored exactly by the method of the Four Russians.

Components are quantised to whole numbers. Candidates are stored as blocks of packed bit planes: for
each plane of the two's complement and each group of eight dimensions one byte. For a block of
anchors the sums of all 256 subsets of every such group are laid out in a table; a candidate's byte
indexes it, the sums of a plane are added over the groups, and planes are shifted and added into the
whole inner product. No score is estimated and no pair is left out.

Two passes over the stored blocks: the first meets anchors with the rows of their label and keeps
their positives, the second meets them with all rows and keeps, for each positive, the best rows of
other labels inside the window of scores. A task holds only the best rows so far of the anchors in
its round, and what tasks return is merged by a ranked window of a few rows per task and anchor.

Anchors are dealt to packed blocks. A round broadcasts as many blocks as ``ROUND`` allows, so its
size does not follow the data; more anchors mean more rounds. Candidates are never shuffled. All
anchors meet all rows, so the work is their product.

Rows without an id, without a label or a vector, with a null or non-finite component, or with a
quantised component over ``LARGEST`` take no part; empty vectors score zero. Vectors of different
lengths are compared as if the shorter one went on with zeros. Equal ids are rows of their own: a
row is never its own positive, a copy of it may be. Rows that tie in score and id are
interchangeable. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.vectors import whole_vectors
from pairloom.storage import materialise

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# Percent of the positive's score between which a negative's score has to lie.
LEAST, MOST = 30, 90
LARGEST = 1 << 24
# Rows of a candidate block and of an anchor block, and entries that a block may have.
BLOCK = 4_096
ANCHORS = 256
ENTRIES = 1 << 22
# Anchors that a round broadcasts.
ROUND = 16_384
_LOW = np.iinfo(np.int64).min

_PACKED = "block long, dims int, planes int, rows binary, ids binary, labels binary, data binary"


def _quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """``row`` (unique), ``vec_id``, ``label`` and whole numbers ``q`` of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None] * len(batch)
            for at, q in whole_vectors(batch.column(2), scale, LARGEST):
                for i, x in zip(at, q.astype("<i4"), strict=True):
                    packed[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["vec_id", "label", "q"]
            )

    known = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"
    ).where("vec_id is not null and label is not null and embedding is not null")
    rows = known.mapInArrow(run, "vec_id long, label long, q binary").where("q is not null")
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "q"))


def bit_planes(q: np.ndarray) -> np.ndarray:
    """Bytes (planes, groups, rows) of whole numbers (rows, dims); the highest plane is the sign."""
    planes = int(max(q.max(initial=0), -1 - q.min(initial=0))).bit_length() + 1
    wide = -(-q.shape[1] // 8) * 8
    padded = np.zeros((len(q), wide), np.int32)
    padded[:, : q.shape[1]] = q
    return np.stack([np.packbits((padded >> k) & 1, axis=1, bitorder="little").T for k in range(planes)])


def subset_sums(q: np.ndarray) -> np.ndarray:
    """Sums (groups, 256, anchors) of all subsets of every eight components of each anchor."""
    groups = -(-q.shape[1] // 8)
    padded = np.zeros((len(q), groups * 8), np.int64)
    padded[:, : q.shape[1]] = q
    # A plane's sum stays below the sum of an anchor's components, which chooses the width.
    bound = int(np.abs(padded).sum(axis=1).max(initial=0))
    kind = np.int16 if bound < 1 << 15 else np.int32 if bound < 1 << 31 else np.int64
    by_dim = padded.T.reshape(groups, 8, len(q)).astype(kind)
    table = np.zeros((groups, 256, len(q)), kind)
    for bit in range(8):
        table[:, 1 << bit : 2 << bit] = table[:, : 1 << bit] + by_dim[:, bit, None]
    return table


def scores(planes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inner products (candidates, anchors) from packed planes and subset sums."""
    groups = min(planes.shape[1], len(table))
    total = np.zeros((planes.shape[2], table.shape[2]), np.int64)
    added, looked_up = np.empty(total.shape, table.dtype), np.empty(total.shape, table.dtype)
    for k in reversed(range(len(planes))):
        added[:] = 0
        for g in range(groups):
            added += np.take(table[g], planes[k, g], axis=0, out=looked_up, mode="clip")
        total += total
        total += -added if k == len(planes) - 1 else added
    return total


def _pack(kind: str, rows_per_block: int):
    """Tasks that pack rows into blocks sorted by id; ``kind`` is ``planes`` or ``whole``."""

    def packed(rows: list[tuple]) -> list:
        rows.sort(key=lambda r: (r[1], r[0]))
        dims = max(len(r[3]) for r in rows)
        q = np.zeros((len(rows), dims), np.int32)
        for i, r in enumerate(rows):
            q[i, : len(r[3])] = r[3]
        columns = [np.array([r[k] for r in rows], "<i8").tobytes() for k in range(3)]
        if kind == "whole":
            return [0, dims, 0, *columns, q.astype("<i4").tobytes()]
        planes = bit_planes(q)
        return [0, dims, len(planes), *columns, planes.tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, dims = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(_NAMES, packed(rows), strict=True))], schema=_ARROW)

        for batch in batches:
            for row, vec_id, label, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(q, "<i4")
                wide = max(dims, len(x))
                if rows and (len(rows) == rows_per_block or (len(rows) + 1) * wide > ENTRIES):
                    yield flush()
                    rows, wide = [], len(x)
                rows.append((row, vec_id, label, x))
                dims = wide
        if rows:
            yield flush()

    return run


_NAMES = ("block", "dims", "planes", "rows", "ids", "labels", "data")
_ARROW = pa.schema(
    [("block", pa.int64()), ("dims", pa.int32()), ("planes", pa.int32())] + [(n, pa.binary()) for n in _NAMES[3:]]
)


def _best(score: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``keep`` of each line by falling score, then id."""
    order = np.lexsort((ids, ~score), axis=-1)[..., :keep]
    return np.take_along_axis(score, order, -1), np.take_along_axis(ids, order, -1)


class _Kept:
    """Best scores and ids so far of every anchor and slot of the blocks that a task has met."""

    def __init__(self, slots: int, keep: int) -> None:
        self.slots, self.keep, self.blocks = slots, keep, {}

    def add(self, block: int, anchors: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` and ``ids`` have the shape (anchors, slots, found); the lowest number means none."""
        if block in self.blocks:
            _, old_score, old_ids = self.blocks[block]
            score, ids = np.concatenate([old_score, score], -1), np.concatenate([old_ids, ids], -1)
        self.blocks[block] = (anchors, *_best(score, ids, self.keep))

    def result(self) -> Iterator[pa.RecordBatch]:
        for anchors, score, ids in self.blocks.values():
            a, s, _ = found = np.nonzero(score > _LOW)
            columns = [anchors[a], s.astype(np.int32), score[found], ids[found]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "slot", "score", "id"])


def _first(score: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor the first rows by falling score of (candidates, anchors); candidates are sorted by id."""
    lines = np.ascontiguousarray(score.T)
    take, bits = min(keep, len(score)), len(score).bit_length()
    none, most = lines == _LOW, 1 << (62 - bits)
    lines[none] = 0
    packed = max(int(lines.max(initial=0)), -int(lines.min(initial=0))) < most
    if packed:
        # Score and place in one number: plain numbers sort faster than an index of them.
        key = (np.where(none, most, -lines) << bits) | np.arange(len(score))
        if take < len(score) // 4:
            key = np.partition(key, take, axis=1)[:, :take]
        key.sort(axis=1)
        order = key[:, :take] & ((1 << bits) - 1)
    lines[none] = _LOW
    if not packed:
        order = np.argsort(~lines, axis=1, kind="stable")[:, :take]
    return np.take_along_axis(lines, order, 1), ids[order]


def _meet_positives(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(1, keep)
        for c, a in _pairs(batches):
            for label in np.intersect1d(c.labels, a.labels):
                mine, theirs = np.flatnonzero(c.labels == label), np.flatnonzero(a.labels == label)
                score = scores(c.planes[:, :, mine], subset_sums(a.q[theirs]))
                score[c.rows[mine][:, None] == a.rows[theirs]] = _LOW
                found, ids = _first(score, c.ids[mine], keep)
                kept.add((a.block, label), a.rows[theirs], found[:, None], ids[:, None])
        yield from kept.result()

    return run


def _meet_negatives(keep: int, positives: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(positives, keep)
        for c, a in _pairs(batches):
            score = scores(c.planes, subset_sums(a.q))
            score[c.labels[:, None] == a.labels] = _LOW
            # Rows that no window of the anchor admits need no order.
            score[(score > a.high.max(axis=1)) | (score < a.low.min(axis=1))] = _LOW
            size = np.count_nonzero(score > _LOW, axis=0).max(initial=0)
            if not size:
                continue
            found, ids = _first(score, c.ids, size)
            # Lines fall, so a window is a run that starts behind all higher scores.
            start = (found[:, None, :] > a.high[:, :, None]).sum(axis=2)
            at = np.minimum(start[:, :, None] + np.arange(keep), size - 1)
            inside = start[:, :, None] + np.arange(keep) < size
            got = np.take_along_axis(found[:, None, :], at, 2)
            got[~inside | (got < a.low[:, :, None])] = _LOW
            kept.add(a.block, a.rows, got, np.take_along_axis(ids[:, None, :], at, 2))
        yield from kept.result()

    return run


class _Block:
    """One packed block as arrays."""

    def __init__(self, values: dict, side: str) -> None:
        self.block = values[f"{side}block"]
        self.rows, self.ids, self.labels = (np.frombuffer(values[f"{side}{n}"], "<i8") for n in ("rows", "ids", "labels"))
        n, dims, planes = len(self.rows), values[f"{side}dims"], values[f"{side}planes"]
        if planes:
            self.planes = np.frombuffer(values[f"{side}data"], np.uint8).reshape(planes, -1, n) if dims else np.zeros((planes, 0, n), np.uint8)
        else:
            self.q = np.frombuffer(values[f"{side}data"], "<i4").reshape(n, dims)
        if not side and "low" in values:
            self.low, self.high = (np.frombuffer(values[b], "<i8").reshape(n, -1) for b in ("low", "high"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, _Block]]:
    for batch in batches:
        for i in range(len(batch)):
            values = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            yield _Block(values, "c_"), _Block(values, "")


def _windows(positives: int, least: int, most: int):
    """Tasks that add to anchor blocks the bounds of negatives' scores for each of their positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = np.frombuffer(row["rows"], "<i8")
                place = {int(r): i for i, r in enumerate(rows)}
                low = np.full((len(rows), positives), np.iinfo(np.int64).max)
                high = np.full((len(rows), positives), _LOW)
                for found in row.pop("found") or []:
                    at, p = (place[found["anchor"]], found["slot"]), found["score"]
                    low[at], high[at] = -(-least * p // 100), most * p // 100
                row["low"], row["high"] = low.astype("<i8").tobytes(), high.astype("<i8").tobytes()
                schema = _ARROW.append(pa.field("low", pa.binary())).append(pa.field("high", pa.binary()))
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def _meet(candidates: DataFrame, anchors: DataFrame, run, keep: int) -> DataFrame:
    """``anchor``, ``slot``, ``place`` (from 0), ``score``, ``id`` over all pairs of blocks, round by round."""
    sides = candidates.withColumnsRenamed({n: f"c_{n}" for n in _NAMES if n != "block"}).withColumn("c_block", F.lit(0)).drop("block")
    blocks, per_round = anchors.count(), max(ROUND // ANCHORS, 1)
    parts = []
    for start in range(0, blocks, per_round):
        numbers = F.sequence(F.lit(start).cast("long"), F.lit(min(start + per_round, blocks) - 1).cast("long"))
        # At most ROUND anchors and ENTRIES entries a block: the broadcast has a bound of its own.
        chosen = F.broadcast(anchors.where(F.col("block").between(start, start + per_round - 1)))
        met = sides.withColumn("block", F.explode(numbers)).join(chosen, "block")
        parts.append(met.mapInArrow(run, "anchor long, slot int, score long, id long"))
    if not parts:
        return candidates.sparkSession.createDataFrame([], "anchor long, slot int, place int, score long, id long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < keep)
    return materialise(ranked.select("anchor", "slot", "place", "score", "id"))


def _anchor_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of at most ``ANCHORS`` anchors, numbered from 0."""
    count = rows.count()
    parts = max(-(-count // ROUND), 1)
    packed = materialise(rows.repartition(parts).mapInArrow(_pack("whole", ANCHORS), _PACKED))
    # Numbers from the blocks of the partitions before; one row per ROUND anchors is counted.
    part = F.spark_partition_id().alias("part")
    placed = materialise(packed.select(part, F.monotonically_increasing_id().alias("at"), *_NAMES[1:]))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    numbered = placed.withColumn("inside", inside).join(F.broadcast(before), "part")
    return materialise(numbered.select((F.col("before") + F.col("inside")).cast("long").alias("block"), *_NAMES[1:]))


def hard_negatives(
    vectors: DataFrame,
    anchors: str,
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` is a condition on ``vec_id`` and ``label``. An anchor's positives are its first
    ``positives`` other rows of the same label by score; a positive's negatives are the first
    ``negatives`` rows of other labels with a score of ``least`` to ``most`` percent of its own.
    """
    rows = _quantised(vectors, scale)
    candidates = materialise(rows.mapInArrow(_pack("planes", BLOCK), _PACKED))
    chosen = rows.where(anchors)
    blocks = _anchor_blocks(chosen)
    best = _meet(candidates, blocks, _meet_positives(positives), positives)
    best = best.select("anchor", F.col("place").alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    bounds = _with_bounds(blocks, best, positives, least, most)
    found = _meet(candidates, bounds, _meet_negatives(negatives, positives), negatives)
    named = found.join(best, ["anchor", "slot"]).join(
        chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor"
    )
    return named.select(
        "anchor_id",
        "positive_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def _with_bounds(blocks: DataFrame, best: DataFrame, positives: int, least: int, most: int) -> DataFrame:
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                anchor = np.frombuffer(rows, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(anchor), block)), pa.array(anchor)], ["block", "anchor"])

    where = blocks.select("block", "rows").mapInArrow(members, "block long, anchor long")
    # A block has at most ANCHORS anchors and so many positives each: its list is bounded.
    found = F.collect_list(F.struct("anchor", "slot", F.col("positive_score").alias("score"))).alias("found")
    listed = where.join(best, "anchor").groupBy("block").agg(found)
    joined = blocks.join(listed, "block", "left").select(*_NAMES, "found")
    return materialise(joined.mapInArrow(_windows(positives, least, most), f"{_PACKED}, low binary, high binary"))
