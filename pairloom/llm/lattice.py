"""Document probability by a subword lattice over an existing vocabulary.

A text is a sequence of words and one end. A word, marked at its front, is any way to spell it with
pieces; pieces are independent, so the forward recursion over the word's bytes, in log space, sums
all segmentations, and the document's probability is the product over words times that of the end.
Every byte is a piece too, so every text has a probability above 0. A word known from training is an
arc over the whole of itself: it has its discounted share of the training words, and the lattice of
pieces has what the discount leaves, so the probabilities of all words still sum to one. A document
repeats its own words: its distribution is drawn around that of the words by a Dirichlet prior, and
the marginal over it is a ratio of gamma functions for each word and its count.

The vocabulary and its first scores come from a file; which pieces exist is never changed. Scores are
fitted by expectation maximisation over the distinct words of all training documents. Word counts
cover all training documents; every whole text is scored.

Counts are added up in tasks before they are shuffled. The most frequent words, at most ``FREQUENT``, are sent
to the tasks with their values; occurrences of other words, none of them hot, join the word table.
Null is empty text: one token, the end. Equal rows get equal results. Without training documents no
word is known and the scores stay those of the file.
"""

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.storage import materialise

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FRONT = "▁".encode()
FREQUENT = 200_000
ROUNDS = 2
SMOOTH = 0.05
# Weight of the word distribution, in words, against the document's own counts.
PRIOR = 2_000.0
_LN10 = float(np.log(10.0))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20
_LOWER = bytes(range(256)).lower()
# Distinct words that a task holds before it passes them on, and words that a lattice step holds.
_HELD = 400_000
_STEP = 4_096


class Pieces(NamedTuple):
    """Pieces by rising hash of their bytes, with log probabilities."""

    hashes: np.ndarray
    log_p: np.ndarray
    longest: int
    lengths: tuple[int, ...]


def _hash(data: bytes) -> int:
    h = 0
    for c in data:
        h = (h * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def vocabulary(path: str = VOCABULARY) -> Pieces:
    """Pieces of a SentencePiece file. Scores of merge ranks become probabilities by Zipf's law,
    log probabilities stay; control pieces are left out and missing single bytes are added."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    scores = [model.get_score(i) for i in range(model.get_piece_size())]
    ranks = min(scores) < -1000
    for i, score in enumerate(scores):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        data = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.encode()
        weight = 1.0 / (10.0 - score) if ranks else float(np.exp(score))
        if model.is_byte(i):
            weight = 1.0 / (10.0 + len(scores))
        found[data] = found.get(data, 0.0) + weight
    for b in range(256):
        found.setdefault(bytes([b]), 1.0 / (10.0 + len(scores)))
    total = sum(found.values())
    items = sorted((_hash(k), len(k), v) for k, v in found.items())
    lengths = tuple(sorted({n for _, n, _ in items}))
    log_p = np.log(np.array([v for *_, v in items]) / total)
    return Pieces(np.array([h for h, *_ in items], np.uint64), log_p, lengths[-1], lengths)


class Lattice:
    """Finds the pieces of many words at once and sums over their segmentations."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        slot = self._slot(pieces.hashes)
        self.order = np.argsort(slot, kind="stable")
        self.sorted = pieces.hashes[self.order]
        # Place of a slot's first piece; pieces of one slot follow each other.
        self.first = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.first[slot[self.order][::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.depth = int(np.bincount(slot.astype(np.int64)).max())
        self.powers = np.cumprod(np.full(pieces.longest + 1, _BASE, np.uint64))

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _SLOT_BITS)

    def arcs(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Start, length, words and pieces of all pieces that are in the words, by rising start.

        ``words`` has a column of bytes for each word.
        """
        m, n = words.shape
        prefix = np.zeros((m + 1, n), np.uint64)
        for j in range(m):
            prefix[j + 1] = prefix[j] * _BASE + words[j] + np.uint64(1)
        found = []
        for size in self.pieces.lengths:
            if size > m:
                break
            h = prefix[size:] - prefix[:-size] * self.powers[size - 1]
            h = h.ravel()
            place = self.first[self._slot(h)]
            at = np.flatnonzero(place >= 0)
            place, some = place[at], h[at]
            known = self.sorted[place] == some
            # Few are not the first piece of their slot.
            rest = np.flatnonzero(~known)
            for k in range(1, self.depth):
                here = np.minimum(place[rest] + k, len(self.sorted) - 1)
                hit = self.sorted[here] == some[rest]
                place[rest[hit]] = here[hit]
                known[rest[hit]] = True
            at, piece = at[known], self.order[place[known]]
            cuts = np.searchsorted(at, np.arange(m - size + 2) * n)
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[i], cuts[i + 1])
                found.append((i, size, at[part] - i * n, piece[part]))
        return sorted(found, key=lambda x: x[0])

    def forward(self, arcs: list, n: int, m: int, log_p: np.ndarray | None = None) -> np.ndarray:
        log_p = self.pieces.log_p if log_p is None else log_p
        # Pieces that begin at a place come after all that end there.
        alpha = np.full((m + 1, n), -np.inf)
        alpha[0] = 0.0
        for start, size, word, piece in arcs:
            end = alpha[start + size]
            end[word] = np.logaddexp(end[word], alpha[start, word] + log_p[piece])
        return alpha

    def log_probability(self, words: np.ndarray, *scores: np.ndarray) -> list[np.ndarray]:
        """Marginals of the words under each of the scores; the pieces in the words are sought once."""
        m, n = words.shape
        arcs = self.arcs(words)
        return [self.forward(arcs, n, m, log_p)[m] for log_p in scores or (self.pieces.log_p,)]

    def expected(self, words: np.ndarray, into: np.ndarray) -> None:
        """Adds each piece's expected number of uses over all segmentations."""
        m, n = words.shape
        arcs = self.arcs(words)
        alpha = self.forward(arcs, n, m)
        beta = np.full((m + 1, n), -np.inf)
        beta[m] = 0.0
        for start, size, word, piece in reversed(arcs):
            step = self.pieces.log_p[piece] + beta[start + size, word]
            into += np.bincount(piece, np.exp(alpha[start, word] + step - alpha[m, word]), len(into))
            begin = beta[start]
            begin[word] = np.logaddexp(begin[word], step)


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and bytes, marked at the front and one word a column, of words of one length at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, edges):
        step = max(1, min(_STEP, (1 << 18) // (int(sizes[group[0]]) + 3))) if len(group) else 1
        for i in range(0, len(group), step):
            part = group[i : i + step]
            data = b"".join(FRONT + words[k] for k in part)
            yield part, np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(len(part), -1).T)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def word_counts(docs: DataFrame, training: Column) -> DataFrame:
    """``word`` (bytes), ``n`` in all documents and ``c`` in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            other, train = counts
            words = list(other | train)
            c = np.fromiter((train[w] for w in words), np.int64, len(words))
            n = np.fromiter((other[w] for w in words), np.int64, len(words)) + c
            other.clear(), train.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n), pa.array(c)], ["word", "n", "c"])

        for batch in batches:
            for text, used in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[used].update(words_of(text))
                if len(counts[used]) > _HELD:
                    yield flush()
        yield flush()

    parts = docs.select(F.col("text").cast("binary").alias("text"), training.alias("used")).mapInArrow(run, "word binary, n long, c long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def fit(counts: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Piece probabilities from expected uses in the distinct training words (``word``, ``c`` > 0).

    The pieces have to spell words that were not seen, so a word counts once however frequent it is.
    """
    for _ in range(rounds):
        model = pieces

        def run(batches: Iterator[pa.RecordBatch], model: Pieces = model) -> Iterator[pa.RecordBatch]:
            lattice, uses = Lattice(model), np.zeros(len(model.hashes))
            for batch in batches:
                for _, data in by_length(batch.column(0).to_pylist()):
                    lattice.expected(data, uses)
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses[at])], ["piece", "uses"])

        parts = counts.where("c > 0").select("word").mapInArrow(run, "piece long, uses double")
        found = parts.groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        if not len(found):
            return pieces
        uses = np.full(len(pieces.hashes), SMOOTH)
        uses[found.column("piece").to_numpy()] += found.column("uses").to_numpy()
        # Rounding lets reruns agree although sums are added in any order.
        pieces = pieces._replace(log_p=np.round(np.log(uses / uses.sum()), 9))
    return pieces


class Shares(NamedTuple):
    """Training words and ends, and the discount of the words' own arcs."""

    words: int
    distinct: int
    ends: int
    discount: float

    @property
    def p_end(self) -> float:
        return (self.ends + 0.5) / (self.words + self.ends + 1.0)

    def log_word(self, count: np.ndarray, log_lattice: np.ndarray) -> np.ndarray:
        """Natural log probability of words from their counts and lattices."""
        rest = np.log(1.0 - self.p_end)
        if not self.words:
            return rest + log_lattice
        with np.errstate(divide="ignore"):
            arc = np.log(np.maximum(count - self.discount, 0.0) / self.words)
        return rest + np.logaddexp(arc, np.log(self.discount * self.distinct / self.words) + log_lattice)


def log_gamma(z):
    """Logarithm of the gamma function for z >= 1, by Stirling's series seven places up.

    For arrays and, with the functions of Spark, for columns.
    """
    log = F.log if isinstance(z, Column) else np.log
    up = z + 7.0
    below = z
    for k in range(1, 7):
        below = below * (z + float(k))
    series = 1.0 / (12.0 * up) - 1.0 / (360.0 * up * up * up) + 1.0 / (1260.0 * up * up * up * up * up)
    return (up - 0.5) * log(up) - up + 0.5 * float(np.log(2 * np.pi)) + series - log(below)


def log10_uses(lp, n, prior: float):
    """Log10 marginal weight of ``n`` uses of a word of log10 probability ``lp``: gamma(x + n) / gamma(x)
    for x = prior times the probability, written so that a vanishing x keeps its logarithm."""
    exp = F.exp if isinstance(lp, Column) else np.exp
    log_x = lp * _LN10 + float(np.log(prior))
    x = exp(log_x)
    return (log_x + log_gamma(x + n) - log_gamma(x + 1.0)) / _LN10


def _values(counts: DataFrame, given: Pieces, fitted: Pieces, shares: Shares) -> DataFrame:
    """``word``, ``n``, ``c``, ``lp``, the log10 probability of the word, and ``spelt``, that of its
    segmentations by the given scores alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(given)
        for batch in batches:
            words = batch.column(0).to_pylist()
            spelt, lp = np.zeros(len(words)), np.zeros(len(words))
            for part, data in by_length(words):
                spelt[part], lp[part] = lattice.log_probability(data, given.log_p, fitted.log_p)
            lp = shares.log_word(batch.column(2).to_numpy(), lp) / _LN10
            spelt = (np.log(1.0 - shares.p_end) + spelt) / _LN10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp), pa.array(spelt)], ["word", "n", "c", "lp", "spelt"])

    return counts.mapInArrow(run, "word binary, n long, c long, lp double, spelt double")


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """All words from the lowest count on with which at most ``most`` words remain.

    Distinct counts are few (k of them need k * (k + 1) / 2 tokens); the words are never sorted.
    """
    falling = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"))
    spectrum = table.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    kept = spectrum.withColumn("upto", F.sum("words").over(falling)).where(F.col("upto") <= most)
    least = kept.agg(F.min("n")).first()[0]
    return table.where(F.lit(False) if least is None else F.col("n") >= least)


def score(docs: DataFrame, training: Column, path: str = VOCABULARY, rounds: int = ROUNDS, frequent: int = FREQUENT, prior: float = PRIOR) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``lattice_score`` per document.

    ``lattice_score`` is the log10 marginal over all segmentations of all words by the vocabulary's own
    scores; of the corpus it knows only how often a text ends.
    """
    counts = materialise(word_counts(docs, training))
    # The end is a token of every training document.
    ends = docs.where(training).count()
    of = [F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2)]
    sums = counts.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v"), *of).first()
    total = (sums["c"] or 0) + ends
    distinct = sums["v"] + (ends > 0)
    # Absolute discounting by the numbers of words seen once and twice.
    discount = min(max((sums["n1"] + 0.5) / (sums["n1"] + 2 * sums["n2"] + 1.0), 0.1), 0.9)
    shares = Shares(sums["c"] or 0, sums["v"], ends, discount)
    given = vocabulary(path)
    table = materialise(_values(counts, given, fit(counts, given, rounds), shares))
    scale = float(np.log10(total + distinct + 1))
    top = _most_frequent(table, frequent).select("word", "c", "lp", "spelt").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(
        (top.column("word").to_pylist(), *(top.column(name).to_numpy() for name in ("c", "lp", "spelt")))
    )
    log_end = float(np.log10(prior * shares.p_end))
    base_end = float(np.log10(ends + 1)) - scale
    spelt_end = float(np.log10(shares.p_end))
    known_end = int(ends > 0)
    names = ["doc_id", "h", "word", "n", "tokens", "known", "base", "lp_sum", "spelt_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, lp, spelt = sent.value
        place = dict(zip(words, range(len(words)), strict=True))
        # The last place stands for words that are not here.
        known = np.append(c > 0, False).astype(np.int64)
        base = np.append(np.log10(c + 1) - scale, 0.0)
        spelt = np.append(spelt, 0.0)
        absent = len(words)
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for row, text in enumerate(batch.column(1).to_pylist()):
                tokens = words_of(text)
                at = np.fromiter(map(place.get, tokens, repeat(absent)), np.int64, len(tokens))
                rest = Counter([tokens[i] for i in np.flatnonzero(at == absent).tolist()])
                used, times = np.unique(at[at < absent], return_counts=True)
                own_words = float(log10_uses(lp[used], times, prior).sum())
                size = np.array([prior, prior + len(tokens) + 1])
                own_words += float(np.subtract(*log_gamma(size))) / _LN10 + log_end
                h = xxhash.xxh64_intdigest(text or b"", 7) - (1 << 63)
                # No word holds a space, so this row meets no word and rows spread by their text.
                own = (b" %d" % h, 0, len(tokens) + 1, int(known[at].sum()) + known_end, float(base[at].sum()) + base_end, own_words, float(spelt[at].sum()) + spelt_end)
                for values in (own, *((w, k, 0, 0, 0.0, 0.0, 0.0) for w, k in rest.items())):
                    columns[0].append(row)
                    columns[1].append(h)
                    for column, value in zip(columns[2:], values, strict=True):
                        column.append(value)
                if len(columns[0]) > 100_000:
                    yield pack(batch, columns)
                    columns = [[] for _ in names]
            yield pack(batch, columns)

    def pack(batch: pa.RecordBatch, columns: list[list]) -> pa.RecordBatch:
        ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(v, k) for v, k in zip(columns[1:], kinds, strict=True))], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = source.mapInArrow(run, "doc_id long, h long, word binary, n long, tokens long, known long, base double, lp_sum double, spelt_sum double")
    joined = rows.join(table.select("word", "c", "lp", "spelt"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    found = joined.select(
        "doc_id",
        "h",
        (F.col("tokens") > 0).cast("long").alias("copies"),
        "tokens",
        (F.col("known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
        (F.col("base") + F.col("n") * (F.log10(c + 1) - F.lit(scale))).alias("base"),
        (F.col("lp_sum") + F.when(F.col("n") > 0, log10_uses(F.col("lp"), F.col("n"), prior)).otherwise(0.0)).alias("lp"),
        (F.col("spelt_sum") + F.col("n") * F.coalesce("spelt", F.lit(0.0))).alias("spelt"),
    )
    sums_of = [F.sum(x).alias(x) for x in ("copies", "tokens", "known", "base", "lp", "spelt")]
    each = found.groupBy("doc_id", "h").agg(*sums_of)
    # Rows with equal id and text were added up together; each gets its share.
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    whole = lambda x: F.expr(f"{x} div copies")
    return each.select(
        "doc_id",
        whole("tokens").alias("n_tokens"),
        whole("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("lp") / F.col("copies")).alias("score"),
        (F.col("spelt") / F.col("copies")).alias("lattice_score"),
    )
