import random
from itertools import combinations

import numpy as np
import pytest
from mossgraph.llm import fragments, jaccard
from mossgraph.llm.components import components


def shingle_set(text, k=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, percent=85, k=4):
    sets = [shingle_set(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return [(d, len(s), least.get(g) if s else d) for (d, _), s, g in zip(rows, sets, group)]


def corpus():
    r = random.Random(1)
    words = ["w%d" % i for i in range(4000)]
    rows, d = [(None, "no id at all here"), (1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "a b c d"), (1007, "A b\tc d")], 0
    for n in (5, 6, 7, 8, 12, 20, 33, 60, 100, 130, 400, 1500):
        base = [r.choice(words) for _ in range(n)]
        for edits in (0, 0, 1, 2, 3, n // 60, n // 40, n // 25, n // 15):
            copy = list(base)
            for _ in range(edits):
                at = r.randrange(len(copy))
                copy[at : at + r.choice([0, 1])] = r.choices(words, k=r.choice([0, 1, 1]))
            rows.append((d, " ".join(copy)))
            d += 1
    r.shuffle(rows)
    return [*rows, rows[3]]


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7, None) for i, t in rows], "doc_id long, text string, node int, h string")
    mine = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.per_document(docs).collect()), key=str)
    assert mine == sorted(brute(rows), key=str)


def test_one_of_each(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, node int")
    kept = [r.doc_id for r in jaccard.one_of_each(docs, 80, 5).collect()]
    expected = {c for d, n, c in brute(rows, 80, 5) if n}
    assert {d for d in kept if d not in (1000, 1001, 1002)} == expected and len(kept) == len(set(kept))
    wordless = [r.doc_id for r in jaccard.one_of_each(docs.union(spark.createDataFrame([(2000, " ", 1), (2001, " ", 1), (2001, None, 1)], docs.schema)), 80, 5).collect() if r.doc_id in (1000, 1001, 1002, 2000, 2001)]
    assert sorted(wordless) == [1000, 1001, 1002, 2000, 2001, 2001]


def test_large_sets_share_a_key():
    """Sets of up to 20,000 shingles with as many differences as a link may have."""
    r = np.random.default_rng(3)
    for percent in (80, 85):
        for n in (300, 1000, 3000, 10_000, 20_000):
            for _ in range(4):
                lost = n * (100 - percent) // (100 + percent)  # replaced: the intersection is n - lost, the union n + lost
                base = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
                other = np.unique(np.concatenate([base[lost:], r.integers(0, 2**64, lost, dtype=np.uint64)]))
                made = jaccard.keys(base, percent)
                assert len(np.intersect1d(made, jaccard.keys(other, percent)))
                assert len(made) < 1.5 * n  # linear
    assert jaccard.missed(3, 2, 0) == 0 and jaccard.missed(163, 162, 900) < jaccard.NEVER < jaccard.missed(16, 15, 88)


def test_group_of_near_copies_that_do_not_link(spark):
    """A base with so many changes in each copy that few link, in more than one block of members."""
    r = random.Random(8)
    base = ["w%d" % i for i in range(60)]
    rows = []
    for d in range(260):
        copy = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            copy[r.randrange(60)] = "x%d" % r.randrange(40)
        rows.append((d, " ".join(copy)))
    before = jaccard.BLOCK
    jaccard.BLOCK = 50
    try:
        got = jaccard.per_document(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        jaccard.BLOCK = before
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute(rows))


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_linking_sets_share_a_key(percent):
    """Pigeonhole, with as many differences as a link may have; empty segments and small sets are met on the way."""
    r = np.random.default_rng(2)
    for _ in range(1500):
        n = int(r.integers(1, 400))
        base = r.integers(0, 2**64, n, dtype=np.uint64)
        lost = int(r.integers(0, n * (100 - percent) // 100 + 1))
        gained = int(r.integers(0, max(1, n * (100 - percent) // 100 - lost + 1)))
        other = np.unique(np.concatenate([base[lost:], r.integers(0, 2**64, gained, dtype=np.uint64)]))
        base = np.unique(base)
        common = len(np.intersect1d(base, other))
        if 100 * common >= percent * (len(base) + len(other) - common):
            assert len(np.intersect1d(jaccard.keys(base, percent), jaccard.keys(other, percent)))
            assert jaccard.hamming(jaccard.sketch(base), jaccard.sketch(other)) <= len(base) + len(other) - 2 * common


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    group = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(60):
        for a, b in pairs:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    mine = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert mine == group
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert jaccard.per_document(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fragment_texts(spark):
    rows = fragments.texts(spark.createDataFrame([(2, "a"), (1, "a"), (None, None), (3, "")], "doc_id long, text string")).collect()
    assert sorted((r.text, r.copies, r.least_id) for r in rows) == [("", 2, 3), ("a", 2, 1)]


def test_narrow_tables_have_few_files(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = components(spark.createDataFrame([(k, k + 2) for k in range(0, 400) if k % 50 < 48], "a long, b long"))
        assert len(found.inputFiles()) <= 16
        assert {x.node: x.component for x in found.collect()} == {k: k // 50 * 50 + k % 2 for k in range(400)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
