from datetime import datetime, timedelta

import pytest
from mossgraph.functions.text import from_cursor
from mossgraph.operators import listing, replicas, store
from mossgraph.operators.embedding import EmbeddingPipeline
from mossgraph.operators.stored import Store
from mossgraph.shared import shared_folder
from pyspark.sql import functions as F

STORED = "id string, collection string, path string, content string, content_hash string, revision string, updated_at timestamp, deleted boolean"
EDGE = "src string, dst string, rel string, props map<string,string>"


def state(spark, rows, edges=()):
    """rows: id, content, day of the change, deleted and path."""
    d = spark.createDataFrame([(i, "v", p or f"{i}.md", c, f"h{c}", f"r{c}", datetime(2024, 1, 1) + timedelta(days=day), gone) for i, c, day, gone, p in rows], STORED)
    revisions = d.select(F.col("id").alias("doc_id"), "revision", F.lit(None).cast("string").alias("author"), F.lit("m").alias("message"), "content_hash", "content", F.col("updated_at").alias("created_at"))
    older = revisions.withColumns({"revision": F.concat(F.lit("old-"), "revision"), "content": F.lit("old")})
    return store.State(d, revisions.unionByName(older), spark.createDataFrame([(a, b, "links-to", {}) for a, b in edges], EDGE), store._operation(d, "UPSERT").limit(0))


def test_digests_find_what_differs(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit("v").alias("collection"), F.concat("id", F.lit(".md")).alias("path"), F.lit("h").alias("content_hash"), F.lit(False).alias("deleted"), F.lit(datetime(2024, 1, 1)).alias("updated_at"))
    other = rows.where("id <> '5'").withColumn("content_hash", F.when(F.col("id") == "77", "x").otherwise(F.col("content_hash"))).unionByName(rows.where("id = '9'").withColumn("id", F.lit("new")))
    a, b = replicas.digests(rows), replicas.digests(other)
    assert replicas.differing(a, a).count() == 0
    expected = {r[0] for r in spark.createDataFrame([("5",), ("77",), ("new",)], "id string").select(replicas.range_of(F.col("id"))).collect()}
    assert {r.range for r in replicas.differing(a, b).collect()} == expected
    assert replicas.above(a, 4).first()[:2] == (0, 3000) and replicas.above(a, 2).count() <= 256
    got = {r.id: (r.winner, r.conflict) for r in replicas.compare(rows, other).collect()}
    assert got == {"5": ("remote", False), "77": ("local", True), "new": ("local", False)}
    assert replicas.compare(rows.limit(0), rows.limit(0)).count() == 0


def test_transfer(spark):
    target = Store(spark, shared_folder(spark))
    target.load(state(spark, [("same", "s", 1, False, None), ("newer", "mine", 9, False, None), ("older", "mine", 1, False, None), ("held", "x", 1, False, None), ("dead", "d", 1, False, None), ("r", "r", 1, False, None)], [("r", "dead"), ("r", "same")]))
    source = state(spark, [("same", "s", 1, False, None), ("newer", "theirs", 3, False, None), ("older", "theirs", 3, False, None), ("bad", None, 1, False, None), ("taker", "t", 1, False, "held.md"), ("dead", "d", 5, True, None)] + [(f"n{i}", f"c{i}", 1, False, None) for i in range(7)], [("older", "same"), ("n1", "n2"), ("newer", "zz"), ("n3", "dead")])
    done = replicas.transfer(source, target, size=3)
    assert done.batches == 3 and done.moved.count() == 9 and done.moved.groupBy("batch").count().count() <= 3
    assert sorted(map(tuple, done.failures.collect())) == [("bad", "read", "unreadable"), ("newer", "documents", "stale"), ("taker", "documents", "path held")]
    now = target.state()
    have = {d.id: (d.content, d.deleted) for d in now.documents.collect()}
    assert have["newer"] == ("mine", False) and have["older"] == ("theirs", False) and have["dead"] == ("d", True) and have["n6"] == ("c6", False) and "bad" not in have and "taker" not in have
    assert sorted((e.src, e.dst) for e in now.edges.collect()) == [("n1", "n2"), ("older", "same"), ("r", "same")]
    assert {r.revision for r in now.revisions.where("doc_id = 'older'").collect()} == {"rmine", "old-rmine", "rtheirs", "old-rtheirs"}
    version = target.tables.version()
    again = replicas.transfer(source, target, size=3)
    assert again.moved.count() == 0 and sorted(r.id for r in again.failures.collect()) == ["bad", "newer", "taker"] and target.tables.version() == version


def test_a_transfer_that_stops_goes_on(spark, monkeypatch):
    target, source = Store(spark, shared_folder(spark)), state(spark, [(f"n{i}", f"c{i}", 1, False, None) for i in range(8)])
    take, left = target.tables._take, [1]

    def once(m):
        if not left:
            raise OSError("lost")
        left.pop()
        return take(m)

    monkeypatch.setattr(target.tables, "_take", once)
    with pytest.raises(OSError, match="lost"):
        replicas.transfer(source, target, size=3)
    monkeypatch.undo()
    first = target.state().documents.count()
    rest = replicas.transfer(source, target, size=3)
    assert 0 <= first < 8 and rest.moved.count() == 8 - first and target.state().documents.count() == 8 and target.state().revisions.count() == 16


# embeddings


def lines(content):
    return F.filter(F.split(content, "\n"), lambda x: x != "")


def test_contents_are_embedded_once(spark):
    docs = spark.createDataFrame([("a", "h1", "one\ntwo"), ("b", "h1", "one\ntwo"), ("c", "h2", "three"), ("d", "h3", ""), ("e", None, None)], "id string, content_hash string, content string")
    folder, seen = shared_folder(spark), []
    p = EmbeddingPipeline(spark, folder, "m", 2, lambda ts: [[len(t), 1.0] for t in ts], lines, batch=2)
    assert p.backfill(docs, shares=3, observer=lambda k, n: seen.append((k, n))) == 3 and len(seen) == 3 and sum(n for _, n in seen) == 3
    assert p.backfill(docs, shares=2) == 0
    assert sorted((r.id, r.chunk, r.vector[0], r.dim) for r in p.of(docs).collect()) == [("a", 0, 3.0, 2), ("a", 1, 3.0, 2), ("b", 0, 3.0, 2), ("b", 1, 3.0, 2), ("c", 0, 5.0, 2)]
    more = docs.unionByName(spark.createDataFrame([("f", "h4", "x")], docs.schema))
    assert p.embed_changed(more) == 1
    other = EmbeddingPipeline(spark, folder, "m2", 1, lambda ts: [[1.0] for _ in ts])
    assert other.backfill(more) == 4 and p.vectors().count() == 8  # each model has its own


def test_a_bad_embedder_writes_nothing(spark):
    docs = spark.createDataFrame([("a", "h1", "one"), ("b", "h2", "two")], "id string, content_hash string, content string")
    folder = shared_folder(spark)
    for embed in (lambda ts: [[1.0]], lambda ts: [[1.0] for _ in ts]):
        with pytest.raises(Exception, match="the embedder returned"):
            EmbeddingPipeline(spark, folder, "m", 2, embed).backfill(docs.coalesce(1))
    good = EmbeddingPipeline(spark, folder, "m", 1, lambda ts: [[1.0] for _ in ts])
    assert good.vectors() is None and good.backfill(docs, 4) == 2 and good.backfill(docs.limit(0)) == 0


# pages


def test_next_cursor(spark):
    rows = spark.createDataFrame([(f"d{i}", False) for i in range(5)], "id string, deleted boolean")
    first = listing.keyset_page(rows, None, 3)
    cursor = first.next_cursor().first().next_cursor
    assert spark.range(1).select(from_cursor(F.lit(cursor)).alias("c")).first().c == "d2"
    assert listing.keyset_page(rows, "d2", 3).next_cursor().first().next_cursor is None and listing.keyset_page(rows.limit(0), None, 3).next_cursor().first().next_cursor is None
