import hashlib
import random
import sys
from collections import Counter

import numpy as np
import pytest
from mossgraph.llm import substrings
from mossgraph.llm.suffixes import common_prefixes, repeated_starts, suffix_array
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, h long, kept string, node int"


def brute_bytes(texts, window):
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if counts[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(g and not p for p, g in zip([0, *gone], gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def brute_words(ids, texts, window):
    words, first = [(t or "").encode().split() for t in texts], {}
    for d, w in zip(ids, words):
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in zip(ids, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def corpus():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, long = prose(80), prose(400)
    texts = [None, "", " ", "short", passage, passage, prose(30) + " " + passage + " " + prose(20), long, long.replace(" a", " b", 3), long + "!", "x" * 900, "ab" * 400, (prose(12) + "\n") * 9, prose(49), prose(50), prose(50)]
    texts += [prose(r.randint(1, 90)) + "\t" + passage for _ in range(12)]
    ids = r.sample(range(1000), len(texts))
    ids[4] = ids[8] = None
    ids[10] = ids[11]
    return list(zip(ids, texts)) + [(ids[7], texts[7])]


@pytest.mark.parametrize("limits", [{}, {"shard_contents": 2, "shard_bytes": 1}])
def test_bytes(spark, limits):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    found = {r.h: r for r in substrings.byte_repeats(docs, **limits).collect()}
    keys = [r.h for r in spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k int, text string").select("k", substrings.fragments.hash_of(F.col("text")).alias("h")).orderBy("k").collect()]
    mine = [(found[h].n_bytes, found[h].n_removed, found[h].n_spans, found[h].kept_sha256) for h in keys]
    assert mine == brute_bytes([t for _, t in rows], 200)
    assert substrings.bytes_per_document(docs).count() == len(rows)


def test_words(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    mine = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.words_per_document(docs).collect())
    ids = [i for i, _ in rows]
    assert mine == sorted((i or -1, *b) for i, b in zip(ids, brute_words(ids, [t for _, t in rows], 50)))


@pytest.mark.parametrize("limits", [{}, {"shard_contents": 1}])
def test_words_at_every_place_of_a_content(spark, limits):
    block = [f"w{i}" for i in range(400)]
    fill = lambda name, n: [f"{name}{i}" for i in range(n)]
    part, whole = block[100:250], block
    rows = [(1, fill("a", 30) + part + fill("b", 30)), (2, whole + whole), (2, fill("c", 7) + whole + fill("d", 9)), (3, fill("e", 5) + whole), (None, whole + fill("f", 3))]
    rows = [(d, " ".join(w)) for d, w in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    mine = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in substrings.word_repeats(docs, **limits).collect())
    assert mine == sorted(brute_words([d for d, _ in rows], [t for _, t in rows], 50))


def test_split_keys_by_window(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    whole, apart = (sorted((r.h, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.word_repeats(docs, **limits).collect()) for limits in ({}, {"shard_contents": 1}))
    assert whole == apart


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.bytes_per_document(docs).count() == substrings.words_per_document(docs).count() == 0


def test_whole_characters(spark):
    made = spark.createDataFrame([(b"\xc3\xa9a\xa9b\xe2\x82", ), (b"", )], "kept binary").select(substrings.whole_characters("kept").alias("t"))
    assert [r.t for r in made.collect()] == ["éab", ""]


def test_replacement_characters_of_a_text_stay(spark):
    passage = " ".join(f"w{i}" for i in range(100))
    rows = [(1, "no \ufffd repeat \ufffd"), (2, "x\ufffd\u00e0" + passage), (3, "y\u3060" + passage + "\ufffd."), (4, None)]
    left = {r.doc_id: r.text for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {1: "no \ufffd repeat \ufffd", 2: "x\ufffd", 3: "y\ufffd.", 4: ""}


def test_suffix_arrays():
    r = random.Random(5)
    for _ in range(200):
        s = np.array([ord(r.choice(r.choice(["ab", "abc", "abcdefgh", "a"]))) - 90 for _ in range(r.randint(1, 120))] + [0], np.int64)
        order = suffix_array(s, 60, 10**6)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        prefix = common_prefixes(s, order, 10**6)
        for a, b in zip(order, order[1:]):
            x, y = s[a:].tolist(), s[b:].tolist()
            assert prefix[b] == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_repeated_starts():
    r = random.Random(6)
    for _ in range(60):
        w = r.choice([3, 5, 9])
        contents = list({bytes(r.choice(b"ab c") for _ in range(r.randint(w, 60))) for _ in range(r.randint(1, 6))})
        counts = Counter(c[i : i + w] for c in contents for i in range(len(c) - w + 1))
        assert [g.tolist() for g in repeated_starts(contents, w)] == [[counts[c[i : i + w]] > 1 for i in range(len(c) - w + 1)] for c in contents]


def test_long_periodic_texts(monkeypatch):
    from mossgraph.llm import suffixes

    r, s = random.Random(8), None
    monkeypatch.setattr(suffixes, "SLICED", 4)
    for _ in range(80):
        period = bytes(r.choice(b"abc") for _ in range(r.randint(1, 5)))
        contents = list({(period * 60)[: r.randint(9, 200)] + bytes(r.choice(b"abz") for _ in range(r.randint(0, 3))) for _ in range(3)})
        counts = Counter(c[i : i + 9] for c in contents for i in range(len(c) - 8))
        assert [g.tolist() for g in repeated_starts(contents, 9)] == [[counts[c[i : i + 9]] > 1 for i in range(len(c) - 8)] for c in contents]
        s = np.concatenate([np.frombuffer(b"\1".join(contents), np.uint8).astype(np.int64), [0]])
        assert suffix_array(s, 130, 10**6).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_two_megabytes_of_one_letter_take_few_steps():
    n = 2_000_000
    for contents in ([b"x" * n], [b"x" * n + b"a", b"bx" * (n // 4)]):
        steps, before = [], sys.getprofile()
        sys.setprofile(lambda frame, event, arg: steps.append(1) if event == "c_call" else None)  # noqa: B023
        try:
            flags = repeated_starts(contents, 200)
        finally:
            sys.setprofile(before)
        assert all(f[:-1].all() for f in flags) and len(steps) < 100_000


def test_anchors_extend_to_every_repeat():
    r, none = random.Random(1), substrings.NO_ID
    for _ in range(300):
        w, letters = r.choice([4, 5, 7, 10]), r.choice(["ab", "abc", "abcdefgh"])
        base = [r.choice(letters) for _ in range(60)]
        texts = []
        for _ in range(r.randint(1, 9)):
            a = r.randint(0, 30)
            own = base[a : a + r.randint(w, 30)] if r.random() < 0.7 else [r.choice(letters) for _ in range(r.randint(w, 40))]
            texts.append([r.choice(letters) for _ in range(r.randint(0, 2))] + own + [r.choice(letters) for _ in range(r.randint(0, 2))])
        ids, first = [r.choice([1, 2, 3, 4, none]) for _ in texts], {}
        for i, t in zip(ids, texts):
            for k in range(len(t) - w + 1):
                first[tuple(t[k : k + w])] = min(first.get(tuple(t[k : k + w]), i), i)
        expected = [[first[tuple(t[k : k + w])] < i != none for k in range(len(t) - w + 1)] for i, t in zip(ids, texts)]
        assert [f.tolist() for f in substrings.anchored([" ".join(t).encode() for t in texts], np.array(ids), w)] == expected


def test_no_extension_without_two_places():
    words = np.array([1, 2, 3, 1, 2, 4, 9], np.uint64)
    right = [x.tolist() for x in substrings.extended(words, np.array([0, 3]), np.array([7, 4]), np.array([0, 0]), 3, right=True)]
    assert right == [[0, 0], [0, 0], [0, 0], [-1, -1]]
    assert [x.tolist() for x in substrings.extended(words, np.array([1, 4]), np.array([1, 4]), np.array([5, 5]), 2, right=False)] == [[5, 5], [0, 0], [-1, -1]]
