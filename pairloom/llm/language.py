"""Languages of mixed text by per-word scores and Viterbi decoding.

Words are runs of letters. The script of a word, by code point ranges, narrows the candidates to the
languages that were seen in that script. A word's score for a language is the log probability of its
letter trigrams, hashed to a fixed number of buckets. Viterbi chooses a language for every word of
the whole text, with a penalty for each switch; runs of words with one language are spans. The
document takes the language with most letters, its score is that language's share of the letters.

Trigrams are learned from at most about ``max_rows`` documents for each language (documented bound);
copies of a text count once. Null texts and texts without a letter are ``und`` with score 0, and so is
every text when nothing could be learned. Scripts that no language was seen in keep all candidates.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.words import bounded_labels, small
from pairloom.storage import materialise

UNKNOWN = "und"
MAX_ROWS = 2_000
BUCKETS = 1 << 15
PENALTY = 10.0
# A script belongs to a language that has at least this share of its letters in it.
SCRIPT_SHARE = 0.01
_BAN = -1e4
# Letters and words that a step holds at once.
_LETTERS = 1 << 20
_WORDS = 1 << 20

# First code points of script ranges; a range ends where the next begins.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"),
    (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"), (0x3200, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))


class Model(NamedTuple):
    languages: tuple[str, ...]
    # (buckets, languages): log probability; (scripts + 1, languages): is a candidate.
    table: np.ndarray
    candidate: np.ndarray


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Script number by code point (0: no letter), and lower case where that is one character."""
    script = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    ends = [s for s, _ in SCRIPTS[1:]] + [0x110000]
    for (start, name), end in zip(SCRIPTS, ends, strict=True):
        script[start:end] = SCRIPT_NAMES.index(name) + 1
    for c in range(0x33480):
        x = chr(c)
        if not x.isalpha():
            script[c] = 0
        elif len(y := x.lower()) == 1:
            lower[c] = ord(y)
    script[0x33480:] = 0
    return script, lower


class Words(NamedTuple):
    """Words of several texts: text number, first and past-last position, script, letters."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    # Bucket of each letter's trigram, and the place of each word's first letter among them.
    bucket: np.ndarray
    first: np.ndarray


def split_words(texts: list[str], tables: tuple[np.ndarray, np.ndarray]) -> Words:
    script_of, lower = tables
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    script = script_of[points]
    letter = script > 0
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    code = np.where(letter, lower[points], 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    before = np.where(at > 0, code[at - 1], 0)
    mixed = (before * np.uint64(0x9E3779B1) + code[at]) * np.uint64(0x85EBCA77) + code[at + 1]
    bucket = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
    text = np.searchsorted(begins, start, side="right") - 1
    first = np.cumsum(end - start) - (end - start)
    return Words(text, start - begins[text], end - begins[text], script[start], bucket, first)


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of at most ``most`` in sum; a larger item stands alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Log probability of each word for each language; far below others for those out of script."""
    out = np.zeros((len(words.start), len(model.languages)), np.float32)
    if len(out):
        for i in range(len(model.languages)):
            out[:, i] = np.add.reduceat(model.table[:, i][words.bucket], words.first)
        out[~model.candidate[words.script]] += _BAN
    return out


def decode(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of every word. ``scores`` holds the texts' words one after the other; the texts
    are stepped through together, longest first."""
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    back = np.zeros(scores.shape, np.uint8 if scores.shape[1] < 256 else np.uint16)
    own = np.arange(scores.shape[1], dtype=back.dtype)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    best = scores[begin[: active[0]]] if longest else scores[:0]
    last = np.zeros(len(sizes), np.int64)
    for t in range(1, longest + 1):
        n = active[t] if t < longest else 0
        ended = best[n:]
        last[n : n + len(ended)] = ended.argmax(axis=1)
        best = best[:n]
        if not n:
            break
        top = best.argmax(axis=1)
        switch = best[np.arange(n), top] - penalty
        stay = best >= switch[:, None]
        at = begin[:n] + t
        back[at] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, switch[:, None]) + scores[at]
        best -= best.max(axis=1, keepdims=True)
    path = np.zeros(len(scores), back.dtype)
    state = last.astype(np.int64)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        path[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return path


def label(texts: list[str | None], model: Model, tables: tuple[np.ndarray, np.ndarray], penalty: float = PENALTY) -> list[tuple[str, float, str]]:
    """Language, share of letters and spans (``language:start:end``, code points) of each text."""
    filled = [t or "" for t in texts]
    out: list[tuple[str, float, str]] = [(UNKNOWN, 0.0, "")] * len(texts)
    if not model.languages:
        return out
    order = sorted(range(len(filled)), key=lambda i: len(filled[i]))
    for lo, hi in _groups([len(filled[i]) + 1 for i in order], _WORDS * 6):
        ids = order[lo:hi]
        parts, scores = [], []
        for a, b in _groups([len(filled[i]) + 1 for i in ids], _LETTERS):
            words = split_words([filled[i] for i in ids[a:b]], tables)
            scores.append(word_scores(words, model))
            parts.append((words.text + a, words.start, words.end))
        text, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        lengths = np.bincount(text, minlength=len(ids))
        path = decode(np.concatenate(scores), lengths, penalty)
        cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (path[1:] != path[:-1])])) if len(text) else np.zeros(0, int)
        stop = np.concatenate([cut[1:], [len(text)]]) - 1 if len(cut) else cut
        letters = np.zeros((len(ids), len(model.languages)))
        np.add.at(letters, (text, path), end - start)
        spans: list[list[str]] = [[] for _ in ids]
        for i, j in zip(cut.tolist(), stop.tolist(), strict=True):
            spans[text[i]].append(f"{model.languages[path[i]]}:{start[i]}:{end[j]}")
        for k, i in enumerate(ids):
            if lengths[k]:
                best = int(letters[k].argmax())
                out[i] = (model.languages[best], float(letters[k, best] / letters[k].sum()), ",".join(spans[k]))
    return out


def learn(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Trigram table from the ``text`` and ``lang`` of a bounded sample of ``docs``."""
    chosen = bounded_labels(docs.where("text is not null"), "lang", max_rows, "language")
    sample = docs.where("text is not null").select("doc_id", "text").join(small(materialise(chosen)), "doc_id")
    sample = materialise(sample.select("label", "text").dropDuplicates())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = letter_tables()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split_words([text], tables)
                seen = sums.setdefault(language, np.zeros(BUCKETS + len(SCRIPT_NAMES) + 1, np.int64))
                seen[:BUCKETS] += np.bincount(words.bucket, minlength=BUCKETS)
                np.add.at(seen, BUCKETS + words.script.astype(int), words.end - words.start)
        for language, seen in sums.items():
            at = np.flatnonzero(seen)
            columns = [pa.array([language] * len(at), pa.string()), pa.array(at), pa.array(seen[at])]
            yield pa.RecordBatch.from_arrays(columns, ["label", "place", "n"])

    parts = sample.mapInArrow(count, "label string, place long, n long")
    counts = parts.groupBy("label", "place").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("label").to_pylist()))
    seen = np.zeros((BUCKETS + len(SCRIPT_NAMES) + 1, len(languages)))
    number = {x: i for i, x in enumerate(languages)}
    seen[counts.column("place").to_numpy(), [number[x] for x in counts.column("label").to_pylist()]] = counts.column("n").to_numpy()
    grams, scripts = seen[:BUCKETS] + 0.1, seen[BUCKETS:]
    table = np.log(grams / grams.sum(axis=0)).astype(np.float32)
    candidate = scripts >= np.maximum(scripts.sum(axis=0) * SCRIPT_SHARE, 1)
    candidate[~candidate.any(axis=1)] = True
    return Model(tuple(languages), table, candidate)


def languages(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``spans`` of every document, from its text alone."""
    kind = T.StructType(
        [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.StringType())]
    )
    built: list = []

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        built or built.append(letter_tables())
        found = label(texts.to_pylist(), model, built[0], penalty)
        columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.string()))]
        return pa.StructArray.from_arrays(columns, kind.names)

    return docs.select("doc_id", run(F.col("text")).alias("r")).select("doc_id", "r.*")
