import math
import random
import re
from collections import Counter

from conftest import plan, rows

from pairloom.functions.bleu import clipped_counts
from pairloom.operators import scoring


def grams(text, n):
    toks = re.findall(r"\w+|[^\w\s]", text.lower())
    return Counter(tuple(toks[i : i + n]) for i in range(len(toks) - n + 1)), len(toks)


def brute(ref, hyp):
    """BLEU-4 from multiset intersections, as a product of roots."""
    r, h = grams(ref, 1)[1], grams(hyp, 1)[1]
    if not r or not h:
        return 0.0
    product = 1.0
    for n in (1, 2, 3, 4):
        total = h - n + 1
        hits = (grams(ref, n)[0] & grams(hyp, n)[0]).total()
        product *= 1e-9 if total <= 0 else (hits / total if hits else 0.5 / total)
    return math.exp(min(0.0, 1 - r / h)) * product**0.25


def scored(spark, pairs):
    refs = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(pairs)], "k int, reference string")
    hyps = spark.createDataFrame([(i, h) for i, (_, h) in enumerate(pairs)], "k int, hypothesis string")
    return scoring.bleu(hyps, refs, ["k"])


def check(spark, pairs):
    got = {r.k: r.bleu for r in scored(spark, pairs).collect()}
    assert len(got) == len(pairs)
    for i, (r, h) in enumerate(pairs):
        assert abs(got[i] - brute(r, h)) < 0.5001e-4, (r, h)


def test_bleu_against_brute_force(spark):
    rng = random.Random(3)

    def text():
        return " ".join(rng.choice(["a", "b", "c", "dd", ",", "x y", "é"]) for _ in range(rng.randint(0, 25)))

    check(spark, [(text(), text()) for _ in range(200)] + [("", "a"), ("a", ""), ("a", "a"), ("a b", "b a b")])


def test_rows_without_a_reference_stay_without_a_score(spark, monkeypatch):
    refs = spark.createDataFrame([(1, "a b c d"), (3, None)], "k int, reference string")
    hyps = spark.createDataFrame([(1, "a b c d"), (2, "x"), (None, "y")], "k int, hypothesis string")
    want = sorted([(1, "a b c d", 1.0), (2, "x", None), (None, "y", None)], key=repr)
    assert rows(scoring.bleu(hyps, refs, ["k"])) == want
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 0)
    assert rows(scoring.bleu(hyps, refs, ["k"])) == want


def test_bleu_of_long_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 900)}" for _ in range(6000)]
    changed = [w if rng.random() > 0.1 else "zz" for w in words]
    check(spark, [(" ".join(words), " ".join(changed)), (" ".join(words[:50]), " ".join(words))])


def test_bleu_stops_at_the_first_order_without_hits(spark):
    rng = random.Random(11)
    # Hits of one, two, three and four words between long runs of words that the reference lacks.
    parts = ["a", "a b", "a b c", "a b c d", "d c", "zz", "yy xx ww", "b b", "c a"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    check(spark, [(r, h) for r in ("a b c d e", "d c b a", "b b b a", "q") for h in texts])
    assert "if(h1 = 0, array_repeat(0, 4)" in clipped_counts("toks", "p")


def test_bleu_of_equal_texts_is_one(spark):
    got = scored(spark, [("the cat sat down", "The cat sat down"), ("a a a a a", "a a a a a")]).collect()
    assert [r.bleu for r in got] == [1.0, 1.0]


def test_bleu_does_not_shuffle_hypotheses(spark):
    assert "Exchange hashpartitioning" not in plan(scored(spark, [("a b", "a c")]))


def test_bleu_by_shuffle_equals_bleu_by_broadcast(spark, monkeypatch):
    pairs = [(f"a b c {i % 5} d", f"a b {i % 3} d") for i in range(60)]
    want = rows(scored(spark, pairs))
    monkeypatch.setattr("pairloom.operators.joins.fits_broadcast", lambda *a, **k: False)
    assert rows(scored(spark, pairs)) == want


def test_ngram_counts(spark):
    texts = ["a b a b a", "", "x", "a  a,a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = rows(scoring.ngram_counts(scoring.tokenize_text(df, "text"), "k", "tokens"))
    want = [
        (i, n, " ".join(g), c) for i, t in enumerate(texts) for n in (1, 2, 3, 4) for g, c in grams(t, n)[0].items()
    ]
    assert got == sorted(want, key=repr)


def test_ngram_counts_of_many_texts_look_runs_up_in_generated_code(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "b", "é", "dd"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += ["", "a " * 40, "x y z " * 9, None]
    # Keys may repeat and be null; a row is a text of its own.
    df = spark.createDataFrame([(None if i % 9 == 0 else f"k{i % 20}", t) for i, t in enumerate(texts)], "k string, text string")
    counted = scoring.ngram_counts(scoring.tokenize_text(df, "text"), "k", "tokens")
    want = [
        (r.k, n, " ".join(g), c) for r in df.collect() for n in (1, 2, 3, 4) for g, c in grams(r.text or "", n)[0].items()
    ]
    assert rows(counted) == sorted(want, key=repr)
    assert "named_struct(value" not in plan(counted)


def test_pass_rate(spark):
    samples = spark.createDataFrame([(1, "m"), (2, "m"), (3, "m")], "sample_id int, model string")
    outcomes = spark.createDataFrame(
        [(1, "m", "1", "1.0"), (1, "m", "2", "3"), (1, "m", None, "null"), (2, "m", "true", "1")],
        "sample_id int, model string, actual string, expected string",
    )
    got = rows(scoring.test_pass_rate(samples, outcomes, ["sample_id", "model"]))
    assert got == [(1, "m", 1, 3, 0.3333), (2, "m", 1, 1, 1.0), (3, "m", 0, 0, 0.0)]


def test_prompts_keep_percent_signs_and_braces(spark):
    df = spark.createDataFrame(
        [("code_generation", "100% {x}", "r%s", "g{}"), ("docstring_generation", "c", "r", None)],
        "task string, prompt string, reference string, generated string",
    )
    out = scoring.judge_prompts(scoring.chat_prompts(df)).collect()
    assert out[0].chat_prompt.endswith("\n\nTask: 100% {x}")
    assert "Task: 100% {x}\n\nReference:\n```python\nr%s\n```\n\nGenerated:\n```python\ng{}\n```" in out[0].judge_prompt
    assert out[1].judge_prompt.startswith("Rate a generated docstring against a reference.\n\nFunction:\n```python\nc\n```")
    assert "Generated docstring: \n\n1 = Wrong or irrelevant" in out[1].judge_prompt
