import itertools
import zlib

import numpy as np
import odd_documents as odd
import pytest

from pairloom.llm import language

SMALL = "/root/testdata/sf0.001"


def best_path(scores, penalty):
    def total(path):
        switches = sum(a != b for a, b in zip(path, path[1:], strict=False))
        return sum(scores[i, s] for i, s in enumerate(path)) - penalty * switches

    return max(total(p) for p in itertools.product(range(scores.shape[1]), repeat=len(scores))), total


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    lengths = np.array([4, 1, 0, 6, 3])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    path = language.decode(scores.copy(), lengths, 2.0)
    at = 0
    for n in lengths:
        if n:
            best, total = best_path(scores[at : at + n], 2.0)
            assert abs(total(path[at : at + n]) - best) < 1e-9
        at += n


def test_words_are_runs_of_letters_with_scripts():
    words = language.split_words(["Ab, çd1e", "", "\U0001f600Жы 漢", "x"], language.letter_tables())
    assert list(zip(words.text.tolist(), words.start.tolist(), words.end.tolist(), strict=True)) == [
        (0, 0, 2), (0, 4, 6), (0, 7, 8), (2, 1, 3), (2, 4, 5), (3, 0, 1),
    ]
    names = [language.SCRIPT_NAMES[s - 1] for s in words.script]
    assert names == ["Latin", "Latin", "Latin", "Cyrillic", "Han", "Latin"]


@pytest.fixture(scope="module")
def model(spark):
    texts = {"en": "the thing and that with other", "fr": "être mère où déjà çà père", "ru": "это был очень странный день"}
    rows = [(i, t + " " + t, k) for i, (k, t) in enumerate(texts.items())]
    rows += [(10 + i, " ".join(reversed(t.split())), k) for i, (k, t) in enumerate(texts.items())]
    return language.learn(spark.createDataFrame([*rows, (99, "x", None), (98, None, "en")], "doc_id long, text string, lang string"))


def test_spans_of_mixed_text(model):
    text = "the thing and that other thing, être mère où déjà père où être день очень"
    found, share, spans = language.label([text], model, language.letter_tables(), 3.0)[0]
    assert [s.split(":")[0] for s in spans.split(",")] == ["en", "fr", "ru"]
    assert spans.startswith("en:0:30,") and 0 < share < 1 and found == "en"
    # Script alone decides for letters that only one language uses.
    assert language.label(["ждут"], model, language.letter_tables())[0][0] == "ru"


def test_odd_documents(spark, model):
    docs = odd.documents(spark)
    got = language.languages(docs, model).collect()
    assert len(got) == docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (200, 201, 202, 203)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    nothing = language.learn(odd.empty(spark))
    assert {r.lang_pred for r in language.languages(docs, nothing).collect()} == {"und"}
    assert language.languages(odd.empty(spark), model).count() == 0


def test_held_out_accuracy(spark):
    from pairloom.llm.queries import op4_language_viterbi, table

    truth = {r.doc_id: r.lang for r in table(spark, SMALL, "documents").collect()}
    got = op4_language_viterbi(spark, SMALL).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id]]
    assert sum(right) / len(right) > 0.95
