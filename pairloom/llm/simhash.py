"""Near duplicates by SimHash and a binary trie self-join.

Fingerprints of 64 bits that differ in at most 3 bits agree on one of four blocks of 16. Every
distinct fingerprint is put under each of its blocks, rotated so that the block leads. Rows are dealt
by so many leading bits that a task's rows, about half of ``LEAF``, sorted, are a binary trie in which
a node is a range. Tasks walk pairs of nodes from the root: within the leading block only nodes with
themselves, as pairs that differ there share another block; behind it a pair that takes different
branches adds a bit to its difference and is pruned over the budget. The last few rows of a pair of
nodes are compared outright. Where more than ``LEAF`` fingerprints share leading bits, each block
value is cut into subtrees of at most that size; pairs of subtrees within the budget become tasks.

A task returns the links of its rows as a spanning forest, never all pairs: components need no more.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.components import Forest, components
from pairloom.storage import materialise

BITS = 64
BUDGET = 3
BLOCKS = BUDGET + 1
BLOCK_BITS = BITS // BLOCKS
SHINGLE = 3
SEED = 42
LEAF = 2048
# Node pairs with at most this many combinations are compared without going deeper.
DIRECT = 4
# Node pairs and combinations that a task holds at once.
FRONTIER = 1 << 19
_HASHES = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash over XXH64 of word shingles; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(len(words) - shingle + 1, 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _HASHES):
        part = zip(starts[i : i + _HASHES], ends[i : i + _HASHES], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], "<u8")
        lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


_LOWER = bytes(range(256)).lower()
# Each byte's bits in the bytes of a word, so that one addition counts eight bits of 255 hashes.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    values = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64)
    return pa.array(values.view(np.int64))


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def trie_links(
    values: np.ndarray,
    lo: np.ndarray,
    hi: np.ndarray,
    lo2: np.ndarray,
    hi2: np.ndarray,
    agreed: int = BLOCK_BITS,
    seen: Counter | None = None,
) -> np.ndarray:
    """Smallest linked row of each row, for pairs of tries given as sorted ranges of ``values``.

    A pair is either a range with itself or two ranges without common rows. Pairs that differ in the
    first ``agreed`` bits are passed over. ``seen`` counts the node pairs that are split and pruned.
    """
    forest = Forest(len(values))
    stack = [(lo, hi, lo2, hi2, np.zeros(len(lo), np.int64), 0)]
    while stack:
        a, b, c, d, diff, depth = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack.append((a[half:], b[half:], c[half:], d[half:], diff[half:], depth))
            a, b, c, d, diff = a[:half], b[:half], c[:half], d[:half], diff[:half]
        combos = (b - a) * (d - c)
        direct = (combos <= DIRECT) | (depth == BITS)
        _compare(values, a[direct], b[direct], c[direct], d[direct], forest)
        go = ~direct
        if not go.any():
            continue
        a, b, c, d, diff = a[go], b[go], c[go], d[go], diff[go]
        bit = ((values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(bit)])
        m, k = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = (a == c) & (b == d)
        # The mirrored pair of a range with itself is left out.
        steps = [(a, m, c, k, 0, None), (m, b, k, d, 0, None), (a, m, k, d, 1, None), (m, b, c, k, 1, ~same)]
        parts = []
        for p, q, r, s, more, only in steps:
            there = (q > p) & (s > r) & ~((p == r) & (q == s) & (q - p < 2))
            there = there if only is None else there & only
            keep = there & (diff + more <= (BUDGET if depth >= agreed else 0))
            if seen is not None:
                seen.update(split=int(there.sum()), pruned=int((there & ~keep).sum()))
            parts.append((p[keep], q[keep], r[keep], s[keep], diff[keep] + more))
        stack.append((*(np.concatenate(x) for x in zip(*parts, strict=True)), depth + 1))
    return forest.root


def _compare(values: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, forest: Forest) -> None:
    combos = (b - a) * (d - c)
    splits = np.searchsorted(np.cumsum(combos), np.arange(FRONTIER, combos.sum() + FRONTIER, FRONTIER)) + 1
    at = 0
    for stop in splits:
        n, w = combos[at:stop], (d - c)[at:stop]
        inside = _ranges(n)
        width = np.repeat(w, n)
        x = np.repeat(a[at:stop], n) + inside // width
        y = np.repeat(c[at:stop], n) + inside % width
        near = (x != y) & (np.bitwise_count(values[x] ^ values[y]) <= BUDGET)
        forest.link(x[near], y[near])
        at = stop


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task, side and rotated value; links with the value turned back."""

    def solve(task, side, block, rot):
        new = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (side[1:] != side[:-1])]))
        lo, hi = new, np.concatenate([new[1:], [len(task)]])
        paired = np.flatnonzero(side[lo] == 1)
        cross = paired - 1
        alone = side[lo] == 0
        alone[cross] = False
        lo1, hi1 = np.concatenate([lo[alone], lo[cross]]), np.concatenate([hi[alone], hi[cross]])
        lo2, hi2 = np.concatenate([lo[alone], lo[paired]]), np.concatenate([hi[alone], hi[paired]])
        root = trie_links(rot, lo1, hi1, lo2, hi2)
        moved = np.flatnonzero(root != np.arange(len(rot)))
        back = (block * BLOCK_BITS).astype(np.uint64)
        value = np.where(back == 0, rot, (rot >> back) | (rot << ((BITS - back) % np.uint64(BITS))))
        return pa.RecordBatch.from_arrays(
            [pa.array(value[moved].view(np.int64)), pa.array(value[root[moved]].view(np.int64))], ["a", "b"]
        )

    held: list[tuple] = []
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        held.append((cols[0], cols[1].astype(np.int64), cols[2].astype(np.int64), cols[3].view(np.uint64)))
        if sum(len(h[0]) for h in held) < 1 << 16 or held[0][0][0] == held[-1][0][-1]:
            continue
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1
        yield solve(*(x[:cut] for x in whole))
        held = [tuple(x[cut:] for x in whole)]
    if held:
        yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _links(rows: DataFrame) -> DataFrame:
    """Spanning links of rows with ``task``, ``side``, ``block`` and ``rot``."""
    # Not by the task itself: rows that come from a join on it are dealt so already, the plan then leaves this step
    # out, and an adaptive plan may read the join's rows in other parts. A trie cut in parts loses links.
    dealt = rows.select("task", "side", "block", "rot").repartition(F.xxhash64("task"))
    # As unsigned numbers, so that a trie's ranges are in the order of their bits.
    unsigned = F.col("rot").bitwiseXOR(F.lit(-(1 << 63)))
    return dealt.sortWithinPartitions("task", "side", unsigned).mapInArrow(_walk, "a long, b long")


def _subtree_tasks(hot: DataFrame, leaf: int) -> DataFrame:
    """Pairs of subtrees of at most ``leaf`` rows for the tries that are larger."""
    trie = ["block", "value"]
    level = F.explode(F.sequence(F.lit(BLOCK_BITS), F.lit(BITS), F.lit(4)))
    nodes = hot.select(*trie, "rot", level.alias("level")).withColumn(
        "prefix", F.expr(f"shiftrightunsigned(rot, {BITS} - level)")
    )
    fits = nodes.groupBy(*trie, "level", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= leaf)
    cut = (
        nodes.join(fits, [*trie, "level", "prefix"])
        .groupBy(*trie, "rot")
        .agg(F.min(F.struct("level", "prefix")).alias("node"))
    )
    cut = materialise(cut)
    tops = cut.select(*trie, "node").distinct()
    one, two = tops.withColumnRenamed("node", "one"), tops.withColumnRenamed("node", "two")
    shared = "least(one.level, two.level)"
    differing = F.expr(
        f"bit_count(shiftrightunsigned(one.prefix, int(one.level - {shared})) "
        f"^ shiftrightunsigned(two.prefix, int(two.level - {shared})))"
    )
    pairs = one.join(two, trie).where((F.col("one") <= F.col("two")) & (differing <= BUDGET))
    sides = F.when(F.col("one") == F.col("two"), F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("node"))))
    sides = sides.otherwise(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("one").alias("node")),
            F.struct(F.lit(1).alias("side"), F.col("two").alias("node")),
        )
    )
    # Two tasks that share a hash are walked as one: links are checked on all bits, and more rows
    # on a side only add pairs.
    task = F.xxhash64("block", "value", "one", "two")
    members = pairs.select(*trie, task.alias("task"), F.explode(sides).alias("s")).select(
        *trie, "task", "s.side", "s.node"
    )
    return cut.join(members, [*trie, "node"]).select("task", "side", "block", "rot")


def linked(prints: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Links ``a``, ``b`` that span the components of distinct fingerprints ``fp``."""
    rotated = [
        F.struct(
            F.lit(i).alias("block"),
            (
                F.col("fp")
                if i == 0
                else F.shiftleft("fp", i * BLOCK_BITS).bitwiseOR(F.shiftrightunsigned("fp", BITS - i * BLOCK_BITS))
            ).alias("rot"),
        )
        for i in range(BLOCKS)
    ]
    # Leading bits by which rows are dealt: as many as make tries of about half a leaf.
    tries = 2 * prints.count() // leaf
    bits = min(tries.bit_length(), BLOCK_BITS)
    value = F.shiftrightunsigned("rot", BITS - BLOCK_BITS)
    rows = (
        prints.select(F.explode(F.array(*rotated)).alias("r"))
        .select("r.block", "r.rot")
        .withColumn("value", value)
        .withColumn("task", F.col("block") * F.lit(1 << BLOCK_BITS) + F.shiftrightunsigned("value", BLOCK_BITS - bits))
    )
    large = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf).select("task")
    # At most rows / leaf keys; a join by shuffle where that is not small.
    large = materialise(large)
    plain = rows.join(large, "task", "left_anti").withColumn("side", F.lit(0))
    links = _links(plain)
    if large.isEmpty():
        return links
    return links.unionByName(_links(_subtree_tasks(rows.join(large, "task", "left_semi"), leaf)))


def near_duplicates(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``doc_id``, ``fp`` (signed fingerprint) and ``component_id`` for every document.

    Null and empty texts have fingerprint 0 and link like any other. A null id is never the smallest
    id of a component unless the component has no other. Repeated rows link by their fingerprint.
    """
    rows = materialise(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")))
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(linked(classes.select("fp"), leaf))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``docs`` has them."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def distinct_documents(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Where that id has several rows in the table, one of them stays. Columns may have any names.
    """
    kept_id, kept_fp, fp = _fresh(docs, "kept", "kept_fp", "fp")
    found = materialise(near_duplicates(docs, leaf).withColumnRenamed("doc_id", kept_id))
    kept = found.where(F.col(kept_id).eqNullSafe(F.col("component_id")))
    same = docs["doc_id"].eqNullSafe(F.col(kept_id))
    chosen = docs.join(kept.select(kept_id).distinct(), same, "left_semi")
    # An id with several rows, and perhaps several texts: its rows are told apart by fingerprint.
    twice = found.groupBy(kept_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = materialise(twice.select(kept_id))
    if twice.isEmpty():
        return chosen
    prints = kept.select(kept_id, F.col("fp").alias(kept_fp))
    many = chosen.join(twice, same, "left_semi").withColumn(fp, fingerprints(F.col("text")))
    many = many.join(prints, same & (F.col(fp) == F.col(kept_fp)), "left_semi")
    return chosen.join(twice, same, "left_anti").unionByName(many.dropDuplicates(["doc_id", fp]).drop(fp))
