"""Toxicity by a weighted lexicon that Aho-Corasick finds in folded text.

Folding lower-cases, turns look-alike letters of other scripts and digits that stand for letters
into the letter, and punctuation into spaces. Terms match at the start of a word. The lexicon is
learned: beginnings of words that occur in clearly more toxic than clean documents (G squared and log
odds, repetitions within a document up to three), the most significant of each chain of prefixes. Phrases around a term that mark clean
documents become exceptions; a term that starts inside an exception phrase counts for nothing.
The weight of the hits, alone and by length, goes through a logistic curve to a score.

Labels are learned from at most about ``max_rows`` documents for each label value (documented bound);
scoring reads every whole text. Null and empty texts have no hits and get the curve's lowest score.
Rows without a usable label, repeated rows and rows with disagreeing labels teach nothing extra.
Without any toxic or any clean label every score is 0.
"""

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm import logistic
from pairloom.llm.words import bounded_labels
from pairloom.storage import materialise

MAX_ROWS = 5_000
LEAST_G2 = 30.0
LEAST_WEIGHT = 1.5
PREFIXES = range(4, 17)
REPEATS = 3

# Look-alike letters by the Latin letter they resemble.
LOOKALIKES = {
    "a": "аαạ@4", "b": "Ьвβ8", "c": "сϲ", "d": "ԁ", "e": "еε3", "g": "ɡ", "h": "һ", "i": "іιı1", "j": "ј",
    "k": "кκ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοσ0", "p": "рρ", "q": "ԛ", "s": "ѕ5$", "t": "тτ7",
    "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ʐ",
}
_FOLD: dict[int, int | str | None] = {ord(c): " " for c in map(chr, range(128)) if not c.isalnum()}
_FOLD |= {c: " " for c in (*range(0x2000, 0x200B), *range(0x2010, 0x2060), 0xA0, 0xA1, 0xAB, 0xBB, 0xBF, 0x3000)}
_FOLD |= {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD |= {ord(x): letter for letter, alike in LOOKALIKES.items() for x in alike}
_FOLD |= dict.fromkeys((0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD))


class Lexicon(NamedTuple):
    """Terms with weights, exception phrases, and the curve over (1, log weight, log weight by length)."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]


def fold(text: str | None) -> str:
    return " " + (text or "").lower().translate(_FOLD)


def automaton(terms: tuple, exceptions: tuple = ()) -> ahocorasick.Automaton | None:
    """Matcher of terms and exception phrases; None without any."""
    found = ahocorasick.Automaton()
    for term, weight in terms:
        found.add_word(" " + term, (len(term) + 1, weight, False))
    for phrase in exceptions:
        # A phrase may also be a term: it is quiet as a whole word, and longer words still count.
        size, weight, _ = found.get(" " + phrase, (len(phrase) + 1, 0.0, True))
        found.add_word(" " + phrase, (size, weight, True))
    if not len(found):
        return None
    found.make_automaton()
    return found


def hits(folded: str, machine: ahocorasick.Automaton | None) -> dict[int, float]:
    """Start and weight of every word that a term begins, the heaviest term of each word."""
    if machine is None:
        return {}
    best: dict[int, float] = {}
    quiet: list[tuple[int, int]] = []
    for end, (size, weight, phrase) in machine.iter(folded):
        start = end - size + 1
        # A phrase ends with its word.
        if phrase and not folded[end + 1 : end + 2].isalnum():
            quiet.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for start, end in quiet:
        at = start
        while 0 <= at < end:
            best.pop(at, None)
            at = folded.find(" ", at + 1)
    return best


def measure(text: str | None, machine: ahocorasick.Automaton | None) -> tuple[float, float]:
    """Logarithms of the weight of the hits and of that weight per hundred words."""
    folded = fold(text)
    weight = sum(hits(folded, machine).values())
    return math.log1p(weight), math.log1p(100.0 * weight / max(folded.count(" "), 20))


def _counted(make: Callable[[str], dict[str, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences, up to ``REPEATS`` a document, of what ``make`` counts; added up within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(counts)), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (1, 0))]
            counts.clear()
            return pa.RecordBatch.from_arrays([columns[0].cast(pa.string()), *columns[1:]], ["term", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x, n in make(text).items():
                    counts[x][label] += min(n, REPEATS)
                if len(counts) > 500_000:
                    yield flush()
        yield flush()

    return run


def _beginnings(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for w, n in Counter(fold(text).split()).items():
        for k in (*(k for k in PREFIXES if k < len(w)), len(w)):
            if 3 <= k <= PREFIXES[-1]:
                out[w[:k]] = out.get(w[:k], 0) + n
    return out


def _contexts(terms: tuple) -> Callable[[str], dict[str, int]]:
    built: list = []

    def make(text: str) -> dict[str, int]:
        built or built.append(automaton(terms))
        folded = fold(text)
        out: Counter = Counter()
        for start in hits(folded, built[0]):
            end = folded.find(" ", start + 1)
            end = len(folded) if end < 0 else end
            word = folded[start + 1 : end]
            before = folded[:start].rstrip(" ")
            after = folded[end : end + 80].split()
            out[word] += 1
            if before and folded[start - 1] != " ":
                out[f"{before[before.rfind(' ') + 1 :]} {word}"] += 1
            if after and folded[end : end + 2].strip():
                out[f"{word} {after[0]}"] += 1
        return out

    return make


def _g2(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Log-likelihood ratio of a term's two document counts against equal rates."""
    total = (toxic + clean) / float(n_toxic + n_clean)
    term = lambda seen, n: F.when(seen > 0, seen * F.log(seen / (total * n))).otherwise(0.0)
    return 2.0 * (term(toxic, n_toxic) + term(clean, n_clean))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Lexicon:
    """Lexicon, exceptions and curve from a bounded sample of labelled documents.

    ``labels`` has ``doc_id`` and ``label`` (1 is toxic). Copies of a text count once.
    """
    chosen = bounded_labels(labels.where(F.col(label).isin(0, 1)), label, max_rows, "toxicity")
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = materialise(sample.select("text", F.col("label").cast("int").alias("label")).dropDuplicates())
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon((), (), ())

    def count(make: Callable[[str], dict[str, int]]) -> DataFrame:
        parts = sample.mapInArrow(_counted(make), "term string, toxic long, clean long")
        return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1) * (n_clean + 1) / (F.col("clean") + 0.5))
    scored = count(_beginnings).select("term", odds.alias("w"), _g2(F.col("toxic"), F.col("clean"), n_toxic, n_clean).alias("g"))
    scored = scored.where((F.col("g") >= LEAST_G2) & (F.col("w") >= LEAST_WEIGHT))
    # Terms have to stand out in a bounded sample, which bounds their number. Of a chain of
    # beginnings the one that tells most stays.
    kept, covered = {}, set()
    for row in scored.orderBy(F.desc("g"), F.desc(F.length("term")), "term").collect():
        starts = [row["term"][:i] for i in range(1, len(row["term"]) + 1)]
        if row["term"] not in covered and not any(start in kept for start in starts):
            kept[row["term"]] = row["w"]
            covered.update(starts)
    terms = tuple(sorted(kept.items()))
    clean_share = F.col("clean") / n_clean / (F.col("clean") / n_clean + F.col("toxic") / n_toxic)
    phrases = count(_contexts(terms)).where((F.col("clean") >= 5) & (clean_share >= 0.75))
    exceptions = tuple(sorted(r["term"] for r in phrases.select("term").collect()))

    seen = sample.select(_measured(terms, exceptions)(F.col("text")).alias("m"), "label").collect()
    x = np.array([[1.0, r["m"]["weight"], r["m"]["dense"]] for r in seen])
    y = np.array([r["label"] for r in seen], float)
    # Classes are sampled apart; each counts by its share among all labels.
    shares = {r["label"]: r["count"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label")).count().collect()}
    weight = np.where(y == 1, shares[1] / n_toxic, shares[0] / n_clean)
    return Lexicon(terms, exceptions, tuple(logistic.fit(x, y, weight, ridge=1e-4).tolist()))


def _measured(terms: tuple, exceptions: tuple):
    kind = T.StructType([T.StructField("weight", T.DoubleType()), T.StructField("dense", T.DoubleType())])
    built: list = []

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        built or built.append(automaton(terms, exceptions))
        found = np.array([measure(t, built[0]) for t in texts.to_pylist()], float).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], kind.names)

    return run


def toxicity(text: Column, lexicon: Lexicon) -> Column:
    """Score between 0 and 1 of a text column."""
    if not lexicon.curve:
        return F.lit(0.0)
    terms, exceptions, curve = lexicon
    built: list = []

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        built or built.append(automaton(terms, exceptions))
        found = np.array([(1.0, *measure(t, built[0])) for t in texts.to_pylist()], float).reshape(-1, 3)
        return pa.array(logistic.sigmoid(found @ np.array(curve)))

    return score(text)
