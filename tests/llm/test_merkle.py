import hashlib
import zlib
from itertools import groupby

import pytest
from mossgraph.llm import merkle
from mossgraph.llm.common import Scratch
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, pos string, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    fields = [row[0], row[3], row[2], row[4], row[1]]
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """Root, and the siblings of every node, level by level."""
    proofs, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i in range(0, len(nodes), 8):
            for j in range(i, min(i + 8, len(nodes))):
                for k in groups[j]:
                    proofs[k].append((j - i, nodes[i:j] + nodes[j + 1 : i + 8]))
        groups = [sum(groups[i : i + 8], []) for i in range(0, len(nodes), 8)]
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def brute(rows):
    order = lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))
    trees = [(k, list(g)) for k, g in groupby(sorted(rows, key=order), key=lambda r: r[2])]
    made = [climb([leaf(r) for r in g]) for _, g in trees]
    root, upper = climb([m[0] for m in made])
    out = []
    for (_, g), (sub, proofs), top in zip(trees, made, upper, strict=True):
        for r, proof in zip(g, proofs, strict=True):
            whole = proof + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            low = r[1] if r[1] is None or not hit else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            now = leaf((r[0], low, *r[2:]))
            for slot, siblings in whole:
                now = h(*siblings[:slot], now, *siblings[slot:])
            out.append((r[0], leaf(r), sub, root, h(*(s for _, ss in whole for s in ss)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 3])
def test_merkle(spark, block):
    """Several blocks and tiers of them, one row, null keys, ids and texts, repeated rows, long and empty texts."""
    rows = [(i, f"Text {i}", ["en", "de"][i % 9 == 0], "s", i, "x", "y", "z") for i in range(700)]
    rows += [(None, None, None, None, None, None, None, None)] * 3 + [(5, "A", None, "s", 1, "", "", ""), (None, "Bb", "en", "s", 1, "", "", "")] * 2
    rows += [(2**40 + i, "Z" * 300_000 if i else "", "lone" if i else "é", "q", None, "", "", "") for i in range(2)] + [(i, "ÄB", f"k{i}", "s", 1, "", "", "") for i in range(20)]
    got = merkle.per_document(spark.createDataFrame(rows, SCHEMA), block).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_merkle_of_few(spark):
    assert merkle.per_document(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(3, "T", "en", "s", 1, "", "", "")]
    got = merkle.per_document(spark.createDataFrame(one, SCHEMA)).collect()
    assert list(map(tuple, got)) == brute(one) and got[0].root == got[0].leaf and got[0].proof_sha256 == h()


def test_proofs_rebuild_the_root(spark):
    rows = spark.range(1500).select(F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("key"), F.col("id").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(None).cast("string").alias("changed"))
    with Scratch(spark) as scratch:
        got = merkle.folded(scratch, merkle.build(scratch, scratch.written(rows)), proofs=True).collect()
    assert len(got) == 1500 and all(r.verified for r in got)
    for r in got[::97]:
        now = r.leaf
        for step in r.proof:
            now = h(*step.siblings[: step.slot], now, *step.siblings[step.slot :])
        assert now == r.root


def test_parents_resume_states():
    parent = merkle.Parent([h(str(i)) for i in range(8)])
    assert len(parent.states) == 8 and parent.digest == h(*parent.children)
    for slot in range(8):
        assert parent.folded(slot, "new") == h(*parent.children[:slot], "new", *parent.children[slot + 1 :])
    assert parent.digest == h(*parent.children)  # the states are copies
