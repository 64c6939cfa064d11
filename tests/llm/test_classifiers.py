import zlib

import numpy as np
import odd_documents as odd
import pytest

from pairloom.llm import logistic, quality, toxicity
from pairloom.llm.queries import op6_toxicity, op9_quality_ranking, table

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int, text string"


def test_logistic_finds_the_minimum():
    rng = np.random.default_rng(0)
    x = np.c_[np.ones(200), rng.normal(size=200)]
    y = (x[:, 1] + rng.normal(size=200) > 0).astype(float)
    w = logistic.fit(x, y, ridge=0.01)

    def loss(w):
        return -np.mean(y * np.log(logistic.sigmoid(x @ w)) + (1 - y) * np.log(1 - logistic.sigmoid(x @ w))) + 0.005 * w @ w

    assert all(loss(w) <= loss(w + d) for d in np.vstack([np.eye(2), -np.eye(2)]) * 1e-3)


TERMS = (("trash", 2.0), ("idiot", 3.0))


@pytest.mark.parametrize(
    "text, starts",
    [
        ("You TRASH, idiot!", [4, 11]),
        ("tr4sh 1d1ot", [0, 6]),
        ("traѕh і​diot", [0, 6]),
        ("untrash xidiot", []),
        ("white trash bag", []),
        ("white trash idiot", [12]),
        ("off-white trash", []),
        ("", []),
        (None, []),
    ],
)
def test_terms_folding_and_exceptions(text, starts):
    machine = toxicity.automaton(TERMS, ("white trash",))
    assert sorted(toxicity.hits(toxicity.fold(text), machine)) == starts


def brute_hits(folded, terms, exceptions):
    """Every word start against every term, then every place of every phrase."""
    spaces = [i for i, c in enumerate(folded) if c == " "]
    best = {}
    for i in spaces:
        weights = [w for t, w in terms if folded.startswith(" " + t, i) and w > 0]
        if weights:
            best[i] = max(weights)
    for phrase in exceptions:
        for a in spaces:
            end = a + len(phrase)
            if folded.startswith(" " + phrase, a) and not folded[end + 1 : end + 2].isalnum():
                best = {i: w for i, w in best.items() if not a <= i < end}
    return best


def brute_score(text, lexicon):
    folded = toxicity.fold(text)
    weight = sum(brute_hits(folded, lexicon.terms, lexicon.exceptions).values())
    x = (1.0, np.log1p(weight), np.log1p(100 * weight / max(folded.count(" "), 20)))
    return 1 / (1 + np.exp(-np.clip(np.dot(x, lexicon.curve), -30, 30)))


def test_scores_equal_brute_force(spark):
    made = toxicity.Lexicon((("dam", 2.0), ("damn", 3.0), ("id", 1.0), ("idiot", 2.5)), ("dam", "big dam", "idiot proof"), (-2.0, 1.0, 0.5))
    learned = toxicity.learn(table(spark, SF, "documents"), table(spark, SF, "labels"))
    odd_docs = [(d[1],) for d in odd.rows(3)] + [(t,) for t in ("a dam", "damn", "big dam idiot", "id idiot proof idiots", "dam damn dams")]
    docs = spark.createDataFrame(odd_docs, "text string").unionByName(table(spark, "/root/testdata/sf0.001", "documents").select("text"))
    for lexicon in (made, learned):
        got = docs.select("text", toxicity.toxicity(docs["text"], lexicon).alias("s")).collect()
        assert len(got) > 200 and all(abs(r.s - brute_score(r.text, lexicon)) < 1e-9 for r in got)
    assert toxicity.measure("damn", toxicity.automaton(made.terms, made.exceptions))[0] > 0
    assert toxicity.measure("a dam", toxicity.automaton(made.terms, made.exceptions))[0] == 0


def test_ranking_weights_are_the_bradley_terry_optimum(spark, monkeypatch):
    seen = []
    fit = logistic.fit
    monkeypatch.setattr(logistic, "fit", lambda x, y, *a, **k: seen.append((x, y, k["ridge"], fit(x, y, *a, **k))) or seen[-1][3])
    ranker = quality.learn(table(spark, SF, "documents"), table(spark, SF, "labels"))
    (gaps, y, ridge, weights), = seen
    assert (y == 1).all() and np.allclose(weights, ranker.weights)
    # The gradient of the logistic loss on differences, pair by pair, vanishes.
    grad = ridge * weights
    for gap in gaps:
        grad = grad - gap / (1 + np.exp(gap @ weights)) / len(gaps)
    assert np.abs(grad).max() < 1e-8
    rows = table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id").select("text", "quality").collect()
    sums = np.array([np.dot((quality.features(r.text) - ranker.mean) / ranker.scale, ranker.weights) for r in rows])
    good = np.array([r.quality == 1 for r in rows])
    assert (sums[good][:, None] > sums[~good]).mean() > 0.95


def test_ranker_learns_from_every_label(spark):
    """Weights, means and threshold against brute force over all rows, with more than a block of them."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab cd.E1!|"), 3 + i % 40)) + f" {i}" for i in range(9_000)]
    texts += [t + " | | | spam spam" for t in texts[:300]] + texts[:50]
    rows = [(i, t, int(i < 9_000 or i >= 9_300) if i % 97 else int(i % 2), 0) for i, t in enumerate(texts)]
    table_ = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").repartition(3)
    ranker = quality.learn(table_.select("doc_id", "text"), table_.select("doc_id", "quality"))
    distinct = list({(r[2], r[1]): None for r in rows})
    y = np.array([d[0] for d in distinct])
    x = np.array([quality.features(d[1]) for d in distinct])
    assert np.allclose(ranker.mean, x.mean(axis=0)) and np.allclose(ranker.scale, np.maximum(x.std(axis=0), 1e-6))
    z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6)
    sums = z @ np.array(ranker.weights)
    assert abs(ranker.slope - 4 / sums.std()) < 1e-6
    # No cut between half and twice the share of bad labels errs less.
    counts = np.bincount([r[2] for r in rows])
    w = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum()) / len(rows)
    share = w[y == 0].sum()

    def error(cut):
        return w[(sums < cut) & (y == 1)].sum() + w[(sums >= cut) & (y == 0)].sum()

    cuts = np.append(np.sort(sums), np.inf)
    level = np.append(0.0, np.cumsum(w[np.argsort(sums, kind="stable")]))
    allowed = cuts[(level >= share / 2) & (level <= min(2 * share, 1.0))]
    assert abs(error(ranker.threshold) - min(map(error, allowed))) < 1e-9
    # Blocks of any size learn from the same documents; with one block the driver fits them.
    whole = quality.learn(table_.select("doc_id", "text"), table_.select("doc_id", "quality"), block=20_000)
    assert np.allclose(whole.mean, ranker.mean) and np.corrcoef(sums, z @ np.array(whole.weights))[0, 1] > 0.99
    # One packed block gives what the driver's fit gives.
    found = {0: int((y == 0).sum()), 1: int((y == 1).sum())}
    each = (counts[0] / found[0], counts[1] / found[1])
    known = quality.labelled(table_, table_.select("doc_id", table_["quality"].alias("label")))
    packed = quality._learn_blocks(known, 1, found, each)
    assert np.allclose(packed.weights, whole.weights, atol=1e-7) and abs(packed.slope - whole.slope) < 1e-6


def test_features_are_joined_where_labels_are_many(spark, monkeypatch):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    few = quality.learn(docs, labels)
    monkeypatch.setattr(quality, "is_small", lambda _: False)
    assert np.allclose(quality.learn(docs, labels).weights, few.weights)


def test_weight_is_normalised_by_length():
    machine = toxicity.automaton(TERMS)
    short, long = (toxicity.measure("trash " + "w " * n, machine) for n in (50, 500))
    assert short[0] == long[0] and short[1] > long[1]
    assert toxicity.measure("anything", toxicity.automaton(())) == (0.0, 0.0)


@pytest.mark.parametrize("query, column, floor", [(op6_toxicity, "toxic", 0.95), (op9_quality_ranking, "quality", 0.95)])
def test_held_out_accuracy(spark, query, column, floor):
    truth = {r.doc_id: r[column] for r in table(spark, SF, "labels").collect()}
    got = query(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert sum(right) / len(right) > floor and all(0 <= r.score <= 1 for r in got)


def test_preferences_pair_both_classes():
    for good, bad in ((3, 100), (100, 3), (1, 1), (5, 5)):
        up, down = quality.preferences(good, bad, 4)
        assert up.max() < good and down.max() < bad
        assert len(set(zip(up.tolist(), down.tolist(), strict=True))) == len(up)


def test_odd_documents_and_labels(spark):
    docs = odd.documents(spark)
    rows = [(i, int(i % 3 > 0), int(i % 5 == 0), "clash") for i in range(60)]
    rows += [(0, 1, 1, None), (1, None, None, None), (None, 1, 1, None), (999, 0, 1, None), (2, 7, 7, None)]
    labels = spark.createDataFrame(rows, LABELS)
    lexicon = toxicity.learn(docs, labels)
    ranker = quality.learn(docs, labels)
    for score in (toxicity.toxicity(docs["text"], lexicon), quality.quality(docs["text"], ranker)):
        got = [r[0] for r in docs.select(score).collect()]
        assert len(got) == docs.count() and all(0 <= x <= 1 for x in got)
    for few in (labels.where("false"), labels.where("toxic = 0 and quality = 1")):
        assert toxicity.learn(docs, few).curve == ()
        assert quality.learn(docs, few) is None
    assert docs.select(toxicity.toxicity(docs["text"], toxicity.Lexicon((), (), ()))).distinct().collect() == [(0.0,)]
    assert docs.select(quality.quality(docs["text"], None)).distinct().collect() == [(0.3,)]
    empty = odd.empty(spark)
    assert empty.select(toxicity.toxicity(empty["text"], lexicon)).count() == 0


def test_learning_does_not_depend_on_layout(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert toxicity.learn(docs.repartition(5), labels)[:2] == toxicity.learn(docs, labels.repartition(3))[:2]
    one, two = quality.learn(docs.repartition(5), labels), quality.learn(docs, labels)
    assert np.allclose(one.weights, two.weights) and abs(one.threshold - two.threshold) < 1e-9
