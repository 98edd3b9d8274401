import math
import zlib
from itertools import combinations

import numpy as np
from conftest import SF
from mossgraph.llm import quality_model as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, label string"


def test_scores_equal_a_double_loop():
    """The sum-of-squares identity against every pair of features."""
    r = np.random.default_rng(1)
    m = q.Machine(0.3, r.standard_normal(q.FEATURES) / 9, r.standard_normal((q.FEATURES, q.FACTORS)) / 9)
    words = q.Words()
    texts = ["some words and some more", "", "a | b\n###\n" * 5, None, "ÄÖ x1 LOUD!! LOUD!! 　\x85 end.", "one"]
    made = [q.features_of(t, n, words) for t, n in zip(texts, (24, 0, None, -3, 5, 10**9), strict=True)]
    got = m.scores([f for f, _ in made], [w for _, w in made])
    for (f, w), s in zip(made, got, strict=True):
        z = m.intercept + sum(m.linear[i] * x for i, x in zip(f, w, strict=True)) + sum(float(m.factors[i] @ m.factors[j]) * x * y for (i, x), (j, y) in combinations(list(zip(f, w, strict=True)), 2))
        assert math.isclose(s, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_features():
    words = q.Words()
    f, w = q.features_of("Red red\x0bblue", 12, words)
    mine = {int(i): x for i, x in zip(f, w, strict=True) if i < q.BINS}
    assert mine.keys() == {zlib.crc32(b"red") % q.BINS, zlib.crc32(b"blue") % q.BINS} and math.isclose(mine[zlib.crc32(b"red") % q.BINS], math.sqrt(2 / 3)) and math.isclose(sum(x * x for x in mine.values()), 1)
    assert len(f) == len(mine) + len(q.STATISTICS) and list(f) == sorted(set(f))
    again, _ = q.features_of("Red red\x0bblue", 12, words)
    assert list(again) == list(f) and list(q.features_of("Red red\x0bblue", None, words)[0]) != list(f)


def test_remembered_words_change_nothing(monkeypatch):
    texts = [f"w{i} w{i + 1} LOUD{i}!! a" for i in range(50)]
    large = q.Words()
    expected = [q.features_of(t, 1, large) for t in texts]
    monkeypatch.setattr(q, "REMEMBERED", 5)
    small = q.Words()
    for t, (f, w) in zip(texts, expected, strict=True):
        again = q.features_of(t, 1, small)
        assert list(again[0]) == list(f) and list(again[1]) == list(w)
    assert len(small.known) < 20


def test_gradient():
    """A step goes down the slope of the logistic loss, pairs included."""
    learner = q.Learner(np.random.default_rng(2).normal(0, 0.5, (q.FEATURES + 1, 1 + q.FACTORS)), np.full((q.FEATURES + 1, 1 + q.FACTORS), 1e12))
    at, x, sizes, labels = np.array([3, 9, 11, 3]), np.array([0.5, 1.0, 0.2, 1.0]), np.array([3, 1]), np.array([1.0, 0.0])

    def loss(p):
        m = q.Machine(p[-1, 0], p[:-1, 0], p[:-1, 1:])
        s = m.scores([at[:3], at[3:]], [x[:3], x[3:]])
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean() + q.DECAY / 2 * (p[np.unique(at)] ** 2).sum()

    before = learner.parameters.copy()
    learner.learn(at, x, sizes, labels)
    moved = (before - learner.parameters) * 1e6 / q.RATE  # the gradient, as the squares are 1e12
    for i, f in [(3, 0), (9, 1), (3, 2), (11, 4), (q.FEATURES, 0)]:
        up, down = before.copy(), before.copy()
        up[i, f] += 1e-5
        down[i, f] -= 1e-5
        assert math.isclose((loss(up) - loss(down)) / 2e-5, moved[i, f], rel_tol=1e-3, abs_tol=1e-6)
    assert moved[4].sum() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r for r in q.per_document(docs, labels).collect()}
    assert len(scores) == docs.count()
    held = [(scores[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in scores and scores[r.doc_id].held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r, _ in held) and len(held) > 50
    good, bad = ([r.score for r, y in held if y == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.97 * len(good) * len(bad)
    assert all(r.predicted == int(r.score >= 0.3) for r in scores.values()) and min(good) >= 0.3


def test_edges(spark):
    junk, fine = "### *** $$$ " * 40, "a plain text of some words that go on and on, "
    rows = [(i, (junk if i % 2 else fine) + str(i), "en", "s", 1, "x", "y") for i in range(60)] + [(None, None, None, None, None, None, None), (7, "", "en", "s", 0, "", "")] * 2 + [(99, "word " * 400_000, None, None, -5, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = q.per_document(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert all(by[i] > by[i + 1] for i in range(10, 58, 2)) and by[None] is not None
    kept = q.scored(docs, q.fit(docs, labels))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "score"]
    none = q.per_document(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.5}
    assert q.per_document(docs.limit(0), labels).count() == 0
