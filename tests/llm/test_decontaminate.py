import hashlib
import re

import odd_documents as odd
import pytest
from conftest import plan, rows

from pairloom.llm import decontaminate

ITEMS = "item_id long, text string, pos int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", odd.lower(text))


def brute(docs, items, window=10):
    windows = []
    for item, text, *_ in items:
        ws = words(text)
        windows += [(item, ws[i : i + window]) for i in range(max(len(ws) - window + 1, 1)) if ws]
    out = []
    for d in docs:
        ws, hit, found = words(d[1]), set(), set()
        for item, w in windows:
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
        listed = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out.append((d[0], len(ws), len(hit), len(listed), digest, bool(hit)))
    return sorted(out, key=repr)


def items_of(data):
    long = [(i, " ".join(words(data[i][1])[3:25]), 0) for i in (5, 7, 9, 11, 13)]
    odd_ones = [(20, "Another, TEXT of", 0), (21, None, 0), (22, "?!", 0), (None, "one text", 0), (3, long[0][1], 0), (3, long[0][1], 0), (30, "the the the the the the the the the the the", 0)]
    return long + odd_ones


def limit_broadcasts(monkeypatch, sent):
    """Send nothing, or only the offsets of rarest words."""
    monkeypatch.setattr("pairloom.llm.decontaminate.small", lambda df: df)
    monkeypatch.setattr("pairloom.llm.decontaminate.is_small", lambda df: sent == "offsets" and "len" in df.columns)


@pytest.mark.parametrize("sent", ["all", "offsets", "nothing"])
def test_equals_brute_force(spark, sent, monkeypatch):
    if sent != "all":
        limit_broadcasts(monkeypatch, sent)
    data = [r for r in odd.rows(3) if len(r[1] or "") < 10_000]
    data.append((300, "the " * 40, "en", "a", 0, None, None, None))
    docs, items = spark.createDataFrame(data, odd.SCHEMA), spark.createDataFrame(items_of(data), ITEMS)
    got = decontaminate.contamination(docs, items).drop("text_hash")
    assert rows(got) == brute(data, items_of(data))
    clean = {repr(r[0]) for r in brute(data, items_of(data)) if not r[5]}
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert {repr(r.doc_id) for r in kept.collect()} - {"208", "None"} == clean - {"208", "None"}


def test_long_texts_and_empty_tables(spark):
    docs = odd.documents(spark)
    items = spark.createDataFrame([(1, "word " * 12, 0)], ITEMS)
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert got[205].n_hit == got[205].n_words == 30_000
    none = spark.createDataFrame([], ITEMS)
    assert not decontaminate.contamination(docs, none).where("contaminated").count()
    assert decontaminate.contamination(odd.empty(spark), items).count() == 0
    assert decontaminate.clean_documents(docs, none).count() == docs.count()


def test_shuffled_words_carry_no_texts(spark, monkeypatch):
    limit_broadcasts(monkeypatch, "nothing")
    items = spark.createDataFrame([(1, "word " * 12 + "x", 0), (2, "x", 0), (3, "x word word", 0)], ITEMS)
    text = " ".join(["word"] * 3_000 + ["x"] + ["word"] * 3_000)
    docs = spark.createDataFrame([(1, text), (2, "word " * 9 + "X."), (3, "word " * 8 + "x")], "doc_id long, text string")
    windows = decontaminate.item_windows(items)
    found = decontaminate.occurrences(docs, windows)
    met = sorted((r.doc_id, r.start, len(r.words)) for r in found.collect())
    # Of the windows with an x: the one at its item's end, the item of one word, and x and two words.
    ten_words = [(1, i, 10) for i in range(2_991)] + [(1, 3_001 + i, 10) for i in range(2_991)]
    assert met == sorted([*ten_words, (1, 2_991, 10), (1, 3_000, 1), (1, 3_000, 3), (2, 0, 10), (2, 9, 1), (3, 8, 1)])
    # The text is not an output of what is joined with the windows, nor of the exchange under it.
    exchanged = plan(found).split("Exchange")
    assert not any(" ws#" in part.split("\n")[1] for part in exchanged[1:] if "\n" in part)


def test_only_jvm_operations(spark):
    items = spark.createDataFrame([(1, "word " * 12, 0)], ITEMS)
    text = plan(decontaminate.contamination(odd.documents(spark), items))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text and "Cartesian" not in text
