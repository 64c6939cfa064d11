"""Document quality by Bradley-Terry ranking.

A document's score is linear in features of its text. Weights are learned from preference pairs: every
document marked good is preferred to documents marked bad, and the logistic loss is taken on the
difference of features, without an intercept. The scores of labelled documents then give the
threshold: the quantile near the share of bad labels that errs least. A logistic curve puts that
quantile at ``cut``.

Weights, means and threshold come from all labelled documents; copies of a text count once. Pairs are
made inside blocks of about ``BLOCK`` documents, dealt by a hash of the text, with ``OPPONENTS`` pairs
for each document of a block's smaller class. One block is fitted on the driver; more stay in tasks,
which return sums of a fixed size for each Newton step, and the threshold is found in ranges of the
sorted scores. Every whole text is scored. Null and empty texts have the features of an empty
document. Without labels of both kinds every score is ``cut``.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairloom.llm import logistic
from pairloom.llm.mixing import in_order, offsets
from pairloom.llm.words import is_small, known_labels
from pairloom.storage import materialise

# Documents in a block, whose pairs are made in one task.
BLOCK = 8_192
RIDGE = 1e-3
OPPONENTS = 16
CUT = 0.3

# Classes of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 sentence marks, 5 symbols, 6 lines,
# 7 other white space, 8 bytes of characters beyond ASCII, 9 bars, 10 exclamation and question marks.
_CLASSES = np.zeros(256, np.uint8)
for _value, _chars in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"#$%&*=+<>{}[]\\/@^~_`", b"\n\r", b" \t\v\f"), 1
):
    _CLASSES[list(_chars)] = _value
_CLASSES[128:] = 8
_CLASSES[list(b"|")] = 9
_CLASSES[list(b"!?")] = 10
_N_CLASSES = 11


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters, as they are and in logarithm, and measures of words and lines."""
    data = (text or "").encode()
    shares = np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=_N_CLASSES) / max(len(data), 1)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    follow = sum(map(bytes.__eq__, words[1:], words[:-1])) / n
    distinct = len(set(words)) / n
    expected = n**-0.25
    more = [
        np.log1p(len(words)),
        sizes.mean() if len(words) else 0.0,
        sizes.std() if len(words) else 0.0,
        distinct,
        np.log(max(distinct, 1e-4) / expected),
        follow,
        np.log(follow + 1e-2),
        1.0 - len(set(lines)) / max(len(lines), 1),
        np.log1p(len(words) / max(len(lines), 1)),
    ]
    return np.concatenate([shares, np.log(shares + 1e-3), more])


class Ranker(NamedTuple):
    """Linear weights over standardised features, and the curve that turns a sum into a score."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    slope: float


def _sum(x: np.ndarray, model: Ranker) -> np.ndarray:
    return (x - np.array(model.mean)) / np.array(model.scale) @ np.array(model.weights)


def preferences(good: int, bad: int, opponents: int = OPPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Indices of preferred and other documents: each one of the smaller class meets ``opponents``."""
    small, large = min(good, bad), max(good, bad)
    each = min(opponents, large)
    one = np.repeat(np.arange(small), each)
    other = (one * each + np.tile(np.arange(each), small)) % large
    return (one, other) if good <= bad else (other, one)


def _vectors() -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return run(F.col("text"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``label``, features ``x`` and text hash ``h`` of each distinct labelled text."""
    texts = docs.select("doc_id", "text")
    hashed = F.xxhash64("text").alias("h")
    if is_small(labels):
        rows = texts.join(F.broadcast(labels), "doc_id").select("label", _vectors().alias("x"), hashed)
    else:
        # Features are shuffled in place of texts.
        rows = texts.select("doc_id", _vectors().alias("x"), hashed).join(labels, "doc_id").drop("doc_id")
    return materialise(rows.dropDuplicates(["label", "h"]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", block: int | None = None) -> Ranker | None:
    """Ranker from all labelled documents; None without labels of both kinds."""
    usable = labels.where(F.col(label).isin(0, 1))
    rows = labelled(docs, materialise(known_labels(usable, label)))
    found = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(found) < 2:
        return None
    # Distinct texts count as often as their class has labels.
    shares = {r["label"]: r["count"] for r in usable.groupBy(F.col(label).alias("label")).count().collect()}
    each = (shares[0] / found[0], shares[1] / found[1])
    blocks = -(-sum(found.values()) // (block or BLOCK))
    return _learn_block(rows, each) if blocks == 1 else _learn_blocks(rows, blocks, found, each)


def _learn_block(rows: DataFrame, each: tuple[float, float]) -> Ranker:
    """Fit on the driver; the rows are at most a block."""
    # Sorted so that the pairs are the same in every run.
    found = sorted(((r["label"], r["h"], r["x"]) for r in rows.collect()), key=lambda r: r[:2])
    x = np.array([r[2] for r in found])
    y = np.array([r[0] for r in found], int)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - mean) / scale
    gaps = _gaps(z, y)
    weights = logistic.fit(gaps, np.ones(len(gaps)), ridge=RIDGE)
    sums = z @ weights
    threshold = _threshold(sums, y, np.where(y == 1, each[1], each[0]))
    return Ranker(tuple(mean), tuple(scale), tuple(weights), threshold, 4.0 / max(float(sums.std()), 1e-6))


def _gaps(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differences of features of a block's pairs."""
    order = np.random.default_rng(0).permutation(len(y))
    good, bad = order[y[order] == 1], order[y[order] == 0]
    up, down = preferences(len(good), len(bad))
    return z[good[up]] - z[bad[down]]


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """A row per block: features, labels and hashes as bytes, in order of label and hash."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("h", "ascending")])
        parts = (table["x"].combine_chunks().flatten(), table["label"], table["h"])
        kinds = (np.float64, np.int8, np.int64)
        return pa.table({n: pa.array([np.asarray(v).astype(k).tobytes()], pa.binary()) for n, v, k in zip("xyh", parts, kinds)})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "h"), F.lit(blocks)))
    return materialise(dealt.groupBy("block").applyInArrow(pack, "x binary, y binary, h binary"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for x, y, h in zip(*batch.columns, strict=True):
            y, h = np.frombuffer(y.as_buffer(), np.int8), np.frombuffer(h.as_buffer(), np.int64)
            yield np.frombuffer(x.as_buffer(), np.float64).reshape(len(y), -1), y, h


def _total(packed: DataFrame, measure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a vector of fixed size over all blocks; a task returns one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for x, y, _ in _unpacked(batches):
            total = total + measure(x, y)
        if not np.isscalar(total):
            yield pa.record_batch({"total": pa.array([total.tobytes()], pa.binary())})

    return sum(np.frombuffer(r["total"], np.float64) for r in packed.mapInArrow(run, "total binary").collect())


def _learn_blocks(rows: DataFrame, blocks: int, found: dict[int, int], each: tuple[float, float]) -> Ranker:
    """Fit in tasks; the driver holds sums whose size is that of the features squared."""
    packed = _packed(rows, blocks)
    n = sum(found.values())
    mean = _total(packed, lambda x, y: x.sum(axis=0)) / n
    scale = np.maximum(np.sqrt(_total(packed, lambda x, y: ((x - mean) ** 2).sum(axis=0)) / n), 1e-6)

    def derivatives(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def measure(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            gaps = _gaps((x - mean) / scale, y)
            p = logistic.sigmoid(gaps @ w)
            return np.r_[len(gaps), gaps.T @ (p - 1), ((gaps * (p * (1 - p))[:, None]).T @ gaps).ravel()]

        total = _total(packed, measure)
        total = total[1:] / max(total[0], 1.0)
        return total[: len(w)], total[len(w) :].reshape(len(w), -1)

    weights = logistic.newton(len(mean), derivatives, RIDGE)
    middle = _total(packed, lambda x, y: ((x - mean) / scale @ weights).sum(keepdims=True))[0] / n
    spread = _total(packed, lambda x, y: (((x - mean) / scale @ weights - middle) ** 2).sum(keepdims=True))[0] / n

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, h in _unpacked(batches):
            yield pa.record_batch({"s": (x - mean) / scale @ weights, "label": y.astype(np.int32), "h": h})

    threshold = _threshold_in_ranges(packed.mapInArrow(scored, "s double, label int, h long"), found, each)
    return Ranker(tuple(mean), tuple(scale), tuple(weights), threshold, 4.0 / max(float(np.sqrt(spread)), 1e-6))


def _threshold_in_ranges(sums: DataFrame, found: dict[int, int], each: tuple[float, float]) -> float:
    """The same as :func:`_threshold` for sums that are sorted in ranges, from counts of labels below each place."""
    n = found[0] + found[1]
    total = found[0] * each[0] + found[1] * each[1]
    share = found[0] * each[0] / total
    order = F.struct("s", "label", "h")
    ranged = in_order(sums, order)
    before = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.join(offsets(ranged, n=F.count(F.lit(1)), good=F.sum("label")), "part").select(
        "s",
        (F.col("earlier_n") + F.count(F.lit(1)).over(before)).alias("at"),
        (F.col("earlier_good") + F.coalesce(F.sum("label").over(before), F.lit(0))).alias("good"),
    )
    good, bad = F.col("good") * F.lit(each[1] / total), (F.col("at") - F.col("good")) * F.lit(each[0] / total)
    level = good + bad
    cuts = counted.where((level >= share / 2) & (level <= min(2 * share, 1.0))).select(
        (F.lit(share) + good - bad).alias("error"), F.abs(level - share).alias("off"), "at"
    )
    best = cuts.agg(F.min(F.struct("error", "off", "at")).alias("b")).first()["b"]
    # A cut above all rows, where that is allowed.
    found_cuts = ([tuple(best)] if best else []) + ([(1.0 - share, 1.0 - share, n)] if 2 * share >= 1.0 else [])
    at = min(found_cuts)[2] if found_cuts else n // 2
    beside = {r["at"]: r["s"] for r in counted.where(F.col("at").isin(max(at - 1, 0), min(at, n - 1))).collect()}
    return float((beside[max(at - 1, 0)] + beside[min(at, n - 1)]) / 2)


def _threshold(sums: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Of the score quantiles from half to twice the share of bad labels, the one with the least error."""
    order = np.argsort(sums, kind="stable")
    s, bad, w = sums[order], y[order] == 0, weight[order] / weight.sum()
    share = w[bad].sum()
    # Below position i is called bad.
    error = np.concatenate([[share], share + np.cumsum(np.where(bad, -w, w))])
    level = np.concatenate([[0.0], np.cumsum(w)])
    allowed = np.flatnonzero((level >= share / 2) & (level <= min(2 * share, 1.0)))
    best = allowed[np.lexsort((np.abs(level[allowed] - share), error[allowed]))[0]] if len(allowed) else len(s) // 2
    below, above = s[max(best - 1, 0)], s[min(best, len(s) - 1)]
    return float((below + above) / 2)


def quality(text: Column, model: Ranker | None, cut: float = CUT) -> Column:
    """Score between 0 and 1; ``cut`` is the threshold quantile."""
    if model is None:
        return F.lit(cut)
    base = float(np.log(cut / (1 - cut)))

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in texts.to_pylist()]).reshape(-1, len(model.mean))
        return pa.array(logistic.sigmoid(base + model.slope * (_sum(x, model) - model.threshold)))

    return score(text)
