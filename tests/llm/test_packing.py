import random
import struct
import zlib

import odd_documents as odd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm import packing

SMALL = "/root/testdata/sf0.001"
WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = packing.Words(packing.vocabulary())


def encoded(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=" \n\t\r  '’abzCÄß1²×.,$\x0b\x1c\x85 　​漢ɏƻɐ\U0001f600s't", max_size=20), max_size=20))
@settings(max_examples=300, deadline=None)
def test_words_give_the_ids_of_the_whole_text(texts):
    assert [x.tolist() for x in WORDS.ids(pa.array(texts, pa.string()))] == [encoded(t) for t in texts]


def test_special_tokens_long_words_and_small_tables(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 3)
    monkeypatch.setattr(packing, "_SLICE", 40)
    texts = ["a<|endoftext|> b  <|endoftext|>", "x" * 3000 + " y", "", "  a  b   c ", " ", "don't we'll", "one two three four five", "Äpfel.\nUnd"]
    assert [x.tolist() for x in packing.Words(packing.vocabulary()).ids(pa.array(texts))] == [encoded(t) for t in texts]


def brute_pieces(text, length):
    ids = [*encoded(text or ""), 2]
    first = len(ids) % length or length
    cuts = [0] if len(ids) <= length else [0, *range(first, len(ids), length)]
    return [(k, a, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True))]


def check(docs, out, length):
    """Every piece as by brute force, sequences without gaps or overlaps; returns the number of sequences."""
    want = sorted(
        (repr(d), k, a, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for d, t in docs for k, a, x in brute_pieces(t, length)
    )
    found = out.collect()
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= length
    return len(sequences)


@pytest.mark.parametrize(("length", "most", "share"), [(1024, 4096, 1 << 25), (16, 3, 500), (7, 1, 1 << 25)])
def test_documents_are_packed_whole(spark, length, most, share):
    data = [(r[0], r[1]) for r in odd.rows(1)]
    out = packing.packed(odd.documents(spark, 1).repartition(3), length=length, most=most, share=share)
    check(data, out, length)


def test_small_table_is_packed_closely(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    used = check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], packing.packed(docs), 1024)
    tokens = packing.pieces(docs).agg({"length": "sum"}).first()[0]
    assert used <= 1.1 * tokens / 1024 + 1
    assert packing.packed(odd.empty(spark)).count() == 0


def test_bins_are_best_fit():
    rng = random.Random(2)
    for most in (1, 2, 5, 100):
        bins, plain, count = packing.Bins(20, most), {}, 0
        for _ in range(2000):
            size = rng.randint(1, 20)
            number, offset = bins.put(size)
            fitting = [free for free in plain.values() if free >= size]
            if fitting:
                assert plain[number] == min(fitting) and offset == 20 - min(fitting)
            else:
                assert number == count and offset == 0
                count += 1
            left = plain.pop(number, 20) - size
            if left:
                if len(plain) == most:
                    fullest = min(plain.values())
                    closed = [n for n, free in plain.items() if free == fullest]
                    plain.pop(closed[-1])
                plain[number] = left
        assert bins.used == count
