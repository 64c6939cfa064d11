"""Packing of tokenised documents into sequences of one length by bounded-space best fit.

Documents are tokenised where they are stored; only their pieces' numbers go on. Pieces are dealt
evenly to packers, about ``SHARE`` tokens each, so that the number of packers follows the corpus and
no packer sees more than its share. A packer takes its pieces in the order of a hash and keeps at
most ``OPEN`` open sequences in a bitset keyed by free space: the lowest set bit at or above a
piece's length names the tightest open sequence that still takes it. Where none does, a new one is
opened; over the bound the fullest closes. A piece of the whole length is a sequence of its own.

The tokeniser acts on words apart, so a task cuts texts at spaces and tokenises each distinct word of
a slice of texts once, by the tokeniser's own model where a word is plain (letters, digits and signs
of a fixed range, which the tokeniser's own rule cuts alike) and by the whole tokeniser where it is
not. Texts in which a space is not such a cut, or that name a special token, are tokenised whole.

A null or empty text is the end mark alone. Rows with equal ids, or null ones, are documents of
their own. Longer documents are cut into pieces of the sequence length, the first of which takes the
odd rest. An empty table has no pieces.
"""

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.storage import materialise

LENGTH = 1_024
END = 2
OPEN = 4_096
SHARE = 1 << 25
# Parts of words whose ids a task keeps, the longest of them, and bytes of text in a slice.
KEPT = 1 << 19
_LONG = 64
_SLICE = 1 << 25
# Words whose ids are put together at once.
_GATHERED = 1 << 18
# Letters up to U+024F, digits, and signs without the apostrophe, which may belong to the letters after it.
_LETTERS, _DIGITS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", "0-9", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[{_LETTERS}{_DIGITS}{_SIGNS}]+(?:\n[{_LETTERS}{_DIGITS}{_SIGNS}]+)*")
_PARTS = re.compile(rf" ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[{_SIGNS}]+|\n")
_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# A space between white space, or between white space and the end, belongs to the white space.
_NO_CUT = f"{_BLANK} ({_BLANK}|$)"
# Bytes as the characters that stand for them in a byte-level vocabulary.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def vocabulary(path: str | None = None) -> str:
    """The tokeniser file's text, read on the driver and sent to the tasks; its size does not follow the data."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


class Words:
    """Token ids of texts, the same as those of the tokeniser on the whole text."""

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(source)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, list[int]] = {}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else []

    def _part(self, part: str) -> list[int]:
        if part.isascii():
            shown = part.replace(" ", "Ġ").replace("\n", "Ċ")
        else:
            shown = part.encode().decode("latin-1").translate(_BYTES)
        ids = [t.id for t in self.model.tokenize(shown)]
        if len(part) <= _LONG:
            if len(self.parts) >= KEPT:
                self.parts = {}
            self.parts[part] = ids
        return ids

    def word(self, space: str, word: str) -> list[int]:
        """Ids of a word, with the space before it or none."""
        known, text = self.parts.get, space + word
        ids = known(text)
        if ids is not None:
            return ids
        if not _PLAIN.fullmatch(word):
            return self._whole(text)
        found = _PARTS.findall(text)
        if len(found) == 1:
            return self._part(text)
        ids = []
        for part in found:
            ids += known(part) or self._part(part)
        return ids

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text of a column without nulls."""
        sizes = np.cumsum(np.asarray(pc.binary_length(texts)))
        at = 0
        while at < len(texts):
            upto = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _SLICE, "right")), at + 1)
            yield from self._slice(texts.slice(at, upto - at))
            at = upto

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        odd = pc.match_substring_regex(texts, _NO_CUT)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        odd = np.asarray(odd)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        first, ends = np.asarray(split.offsets)[:-1], np.asarray(split.offsets)[1:]
        coded = split.values.dictionary_encode()
        words, index = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        found = [self.word(" ", w) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), "<u4", int(size.sum()))
        begin = np.cumsum(size) - size
        del found, coded
        at = 0
        while at < len(texts):
            upto = max(int(np.searchsorted(ends, first[at] + _GATHERED, "right")), at + 1)
            run = index[first[at] : ends[upto - 1]]
            counts = size[run]
            # A text's first word has no space before it.
            counts[first[at:upto] - first[at]] = 0
            last = np.cumsum(counts)
            ids = flat[np.repeat(begin[run] - last + counts, counts) + np.arange(counts.sum())]
            for i in range(at, upto):
                if odd[i]:
                    yield np.array(self._whole(texts[i].as_py()), "<u4")
                else:
                    a, b = first[i] - first[at], ends[i] - first[at]
                    start = np.array(self.word("", words[run[a]]), "<u4")
                    yield np.concatenate([start, ids[last[a] : last[b - 1]]])
            at = upto


def cuts(n: int, length: int) -> list[int]:
    """Where the pieces of a document of ``n`` tokens start."""
    return [0] if n <= length else [0, *range(n % length or length, n, length)]


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, source: str | None = None) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every document's pieces."""
    text = source or vocabulary()
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(text)
        for batch in batches:
            at, piece, start, size, crc = [], [], [], [], []
            for i, ids in enumerate(words.ids(batch.column(1))):
                raw = ids.tobytes() + mark
                n = len(raw) // 4
                begins = cuts(n, length)
                for k, (a, b) in enumerate(zip(begins, [*begins[1:], n], strict=True)):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(c, pa.int64()) for c in (start, size, crc)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return found.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open sequences by free space; numbers and offsets for pieces one after another."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most = length, most
        self.free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits = self.open = self.used = 0

    def _take(self, space: int) -> int:
        number = self.free[space].pop()
        if not self.free[space]:
            self.bits ^= 1 << space
        self.open -= 1
        return number

    def put(self, size: int) -> tuple[int, int]:
        fitting = self.bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.length, self.used
            self.used += 1
        left = space - size
        if left:
            if self.open == self.most:
                # The fullest closes: it has the least free space.
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.length - space


def packed(
    docs: DataFrame, length: int = LENGTH, end: int = END, source: str | None = None, most: int = OPEN, share: int = SHARE
) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``.

    Every sequence holds at most ``length`` tokens without gaps. Sequence numbers are unique, not dense.
    """
    found = materialise(pieces(docs, length, end, source))
    total = found.agg(F.sum("length")).first()[0] or 0
    packers = max(-(-total // share), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(length, most)
        for batch in batches:
            places = [bins.put(n) for n in batch.column(3).to_pylist()]
            first = batch.column(5).to_numpy() << 33
            number = np.array([p[0] for p in places], np.int64) + first
            offset = pa.array([p[1] for p in places], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(number), offset], [*batch.schema.names[:5], "sequence_id", "offset"]
            )

    # Dealt row by row, so that no id or text can overload a packer; the hash makes the order its own.
    dealt = found.repartition(packers).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), *found.columns)
    numbered = dealt.withColumn("packer", F.spark_partition_id().cast("long"))
    kind = dict(found.dtypes)["doc_id"]
    return numbered.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
