import math
import zlib
from collections import Counter

import numpy as np
import odd_documents as odd
import pytest
from pyspark.sql import functions as F

from pairloom.llm import lattice
from pairloom.llm.words import fold_of


@pytest.fixture(scope="module")
def pieces():
    return lattice.vocabulary()


def brute_log(word, pieces):
    known = dict(zip(pieces.hashes.tolist(), pieces.log_p.tolist(), strict=True))
    data = lattice.FRONT + word
    alpha = [0.0] + [0.0] * len(data)
    for j in range(1, len(data) + 1):
        ways = [alpha[i] + known[h] for i in range(max(0, j - pieces.longest), j) if (h := lattice._hash(data[i:j])) in known]
        top = max(ways)
        alpha[j] = top + math.log(sum(math.exp(w - top) for w in ways))
    return alpha[-1]


WORDS = [b"the", b"ererthan", "ouèéçmentelle".encode(), b"x", b"\xff\x00", b"$$$", b"onthtionhent", b"a" * 300]


def test_forward_sums_all_segmentations(pieces):
    model = lattice.Lattice(pieces)
    assert abs(np.exp(pieces.log_p).sum() - 1) < 1e-9
    for part, data in lattice.by_length(WORDS):
        other = np.log(np.linspace(1, 2, len(pieces.log_p)) * 1e-4)
        own, twice = model.log_probability(data, pieces.log_p, other)
        assert (model.log_probability(data)[0] == own).all()
        for k, value, with_other in zip(part, own, twice, strict=True):
            assert abs(value - brute_log(WORDS[k], pieces)) < 1e-8
            assert abs(with_other - brute_log(WORDS[k], pieces._replace(log_p=other))) < 1e-8


def test_expected_uses_cover_every_byte_once(pieces):
    model, uses = lattice.Lattice(pieces), np.zeros(len(pieces.hashes))
    sizes = {}
    for piece in (WORDS[0], lattice.FRONT + b"the"):
        sizes[lattice._hash(piece)] = len(piece)
    for _, data in lattice.by_length([b"the"]):
        model.expected(data, uses)
    lengths = {lattice._hash((lattice.FRONT + b"the")[i:j]): j - i for i in range(6) for j in range(i + 1, 7)}
    covered = sum(uses[k] * lengths[h] for k, h in enumerate(pieces.hashes.tolist()) if h in lengths)
    assert abs(covered - 6) < 1e-8 and abs(uses.sum() - sum(u for u in uses if u)) < 1e-12


def brute(data):
    used = [zlib.crc32(b"" if d[0] is None else str(d[0]).encode()) % 7 != 2 for d in data]
    tokens = [[odd.lower(w) for w in odd.space_words(d[1])] + [None] for d in data]
    counts = Counter(t for ws, u in zip(tokens, used, strict=True) if u for t in ws)
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, ws in zip(data, tokens, strict=True):
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ws)
        out.append((d[0], len(ws), sum(counts[t] > 0 for t in ws), n, round(base, 4)))
    return sorted(out, key=repr)


def brute_lattice(data, pieces):
    """Every word by all its segmentations, then the end."""
    texts = [[odd.lower(w).encode() for w in odd.space_words(d[1])] for d in data]
    used = [zlib.crc32(b"" if d[0] is None else str(d[0]).encode()) % 7 != 2 for d in data]
    ends, words = sum(used), sum(len(t) for t, u in zip(texts, used, strict=True) if u)
    end = (ends + 0.5) / (words + ends + 1)
    known = {w: brute_log(w, pieces) for w in {w for t in texts for w in t}}
    return [
        (d[0], sum(math.log10(1 - end) + known[w] / math.log(10) for w in t) + math.log10(end))
        for d, t in zip(data, texts, strict=True)
    ]


@pytest.mark.parametrize("frequent", [0, 7, 200_000])
def test_documents_equal_brute_force(spark, frequent, pieces):
    data = odd.rows(6)
    docs = spark.createDataFrame(data, odd.SCHEMA)
    got = lattice.score(docs, fold_of(F.col("doc_id"), 7) != 2, rounds=1, frequent=frequent).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == brute(data)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    want = brute_lattice(data, pieces)
    pure = sorted((repr(r.doc_id), r.lattice_score) for r in got)
    assert [i for i, _ in pure] == sorted(repr(i) for i, _ in want)
    assert np.allclose([x for _, x in pure], [x for _, x in sorted((repr(i), x) for i, x in want)], rtol=1e-9)
    other = lattice.score(docs, fold_of(F.col("doc_id"), 7) != 2, rounds=1).collect()
    assert sorted((repr(r.doc_id), round(r.score, 5)) for r in got) == sorted((repr(r.doc_id), round(r.score, 5)) for r in other)


def test_word_probabilities_stay_a_distribution(pieces):
    shares = lattice.Shares(words=10, distinct=3, ends=2, discount=0.6)
    own = np.exp(shares.log_word(np.array([5, 3, 2]), np.full(3, -np.inf))).sum()
    left = np.exp(shares.log_word(np.array([0]), np.array([0.0])))[0]
    assert abs(own + left + shares.p_end - 1) < 1e-12


def test_marginal_of_repeated_words(spark):
    from pyspark.sql import functions as F

    cases = [(-0.3, 1), (-2.5, 3), (-8.0, 1), (-8.0, 2), (-30.0, 40), (-400.0, 2), (-1.0, 30_000)]
    lp, n = (np.array(c, float) for c in zip(*cases, strict=True))
    got = lattice.log10_uses(lp, n, 50.0)
    for value, (p, k) in zip(got, cases, strict=True):
        want = sum(math.log10(50.0 * 10**p + i) if 10**p or i else p + math.log10(50.0) for i in range(k))
        assert abs(value - want) < 1e-6 * max(1, abs(want))
    df = spark.createDataFrame([(float(p), k) for p, k in cases], "lp double, n long")
    columns = [r[0] for r in df.select(lattice.log10_uses(F.col("lp"), F.col("n"), 50.0)).collect()]
    assert np.allclose(sorted(columns), sorted(got))


def test_empty_table_and_no_training(spark):
    assert lattice.score(odd.empty(spark), F.lit(True), rounds=1).count() == 0
    got = lattice.score(odd.documents(spark), F.lit(False), rounds=1).collect()
    assert {r.n_known for r in got} == {0} and all(math.isfinite(r.score) for r in got)
