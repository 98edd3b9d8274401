from datetime import datetime, timedelta

import pytest
from mossgraph.model import InvalidRequest, Unsupported
from mossgraph.operators import changes, graph, listing, search, store, sync
from mossgraph.operators.search import Filters
from mossgraph.plans.search import SearchRequest, plan
from mossgraph.sources import blobs, files
from pyspark.sql import functions as F



def now():
    return F.expr("timestamp '2030-01-01 00:00:00'")
T0 = datetime(2020, 1, 1)


def edges(spark, *rows):
    return spark.createDataFrame([(*r, {}) if len(r) == 3 else (r[0], r[1], "links-to", {}) for r in rows], "src string, dst string, rel string, props map<string,string>")


def state(spark, *docs, links=()):
    d = spark.createDataFrame([(i, "vault", i + ".md", c, "h" + i, "rev-" + i, T0, gone) for i, c, gone in docs], "id string, collection string, path string, content string, content_hash string, revision string, updated_at timestamp, deleted boolean")
    r = d.select(F.col("id").alias("doc_id"), "revision", F.lit(None).cast("string").alias("author"), F.lit("").alias("message"), "content_hash", "content", F.col("updated_at").alias("created_at"))
    return store.State(d, r, edges(spark, *links) if links else edges(spark, ("x", "y")).limit(0), store._operation(d, "UPSERT").limit(0))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_traverse(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("z", "a"))
    assert rows(graph.traverse(e, ["a"], 3), "id", "depth") == [("a", 3), ("b", 1), ("c", 2), ("d", 1)]
    assert rows(graph.traverse(e, ["a"], 0), "id") == []
    assert rows(graph.traverse(e, ["a"], 1, fanout=1), "id") == [("b",)]
    assert rows(graph.backlinks(e, "a"), "src") == [("c",), ("z",)]
    with pytest.raises(InvalidRequest):
        graph.traverse(e, ["a"], 11)
    assert rows(graph.masked(graph.traverse(e, ["a"], 1), spark.sql("SELECT 'q' AS id"), spark.sql("SELECT 'b' AS id"), "a"), "id") == [("d",)]
    assert rows(graph.masked(graph.traverse(e, ["a"], 1), spark.sql("SELECT 'a' AS id"), spark.sql("SELECT 'b' AS id"), "a"), "id") == []


def test_resolution(spark):
    docs = spark.createDataFrame([("x/a",), ("b/a",), ("a",), ("q/r/s",)], "id string")
    refs = spark.createDataFrame([("a",), ("./r/s.md",), ("none",), ("x/a.MD",)], "target string")
    assert rows(graph.resolved(refs, docs).fillna("-"), "target", "dst") == [("./r/s.md", "q/r/s"), ("a", "a"), ("none", "-"), ("x/a.MD", "x/a")]


def test_upsert(spark):
    s = state(spark, ("a", "old", False), ("b", "same", False), ("t", "gone", True))
    new = spark.createDataFrame([("a", "vault", "new", "rev-a"), ("b", "vault", "x", "wrong"), ("c", "vault", "first", None), ("t", "other", "y", None)], "id string, collection string, content string, expected_revision string")
    out = store.upsert(s, new, now())
    assert rows(out.documents, "id", "content", "deleted") == [("a", "new", False), ("b", "same", False), ("c", "first", False), ("t", "gone", True)]
    assert rows(out.conflicts, "id", "reason") == [("b", "revision"), ("t", "collection")]
    assert rows(out.outbox, "document_id", "kind") == [("a", "UPSERT"), ("c", "UPSERT")]
    again = store.upsert(out, new.where("id = 'c'"), now())
    assert again.revisions.count() == out.revisions.count() == 5
    back = store.upsert(store.upsert(out, spark.sql("SELECT 'a' AS id, 'vault' AS collection, 'third' AS content"), now()), spark.sql("SELECT 'a' AS id, 'vault' AS collection, 'new' AS content"), now())
    assert rows(back.conflicts, "id", "reason") == [("a", "revision exists")]


def test_delete_restore_rename(spark):
    s = state(spark, ("a", "x", False), ("b", "y", False), ("dead", "z", True), links=[("a", "b"), ("b", "a")])
    gone = store.delete(s, spark.sql("SELECT 'a' AS id UNION SELECT 'dead'"), now())
    assert rows(gone.documents.where("deleted"), "id", "revision") == [("a", "deleted-rev-a"), ("dead", "rev-dead")]
    assert rows(gone.conflicts, "id", "reason") == [("dead", "not live")]
    back = store.restore(gone, spark.sql("SELECT 'a' AS id UNION SELECT 'b'"), now())
    assert rows(back.documents.where("id = 'a'"), "revision", "deleted") == [("restored-deleted-rev-a", False)]
    moves = spark.createDataFrame([("a", "dead"), ("b", "a"), ("no", "n")], "old_id string, new_id string")
    out = store.rename(s, moves, now())
    assert rows(out.conflicts, "id", "reason") == [("b", "target live"), ("no", "not live")]
    assert rows(out.documents, "id", "content") == [("b", "y"), ("dead", "x")]
    assert rows(out.edges, "src", "dst") == [("b", "dead"), ("dead", "b")]
    assert rows(out.revisions.where("doc_id = 'dead'"), "revision") == [("renamed-rev-a",), ("rev-a",), ("rev-dead",)]


def test_relink(spark):
    s = state(spark, ("n", "see [[notes/a|A]] and [[b]]", False), ("notes/a", "", False), links=[("n", "notes/a")])
    out = store.relink(s, spark.createDataFrame([("notes/a", "arch/a")], "old_id string, new_id string"), now())
    assert rows(out.documents.where("id = 'n'"), "content", "revision") == [("see [[arch/a|A]] and [[b]]", "relinked-rev-n")]


def test_search_plan(spark):
    docs = spark.createDataFrame([(1, "en", ["t"], ["k=n:1"], "apple pie apple"), (2, "en", [], [], "pie"), (3, "de", ["t"], ["k=s1:1"], None), (4, "de", ["t"], [], "apple AND pie")], "id long, collection string, tags array<string>, fm_terms array<string>, text string")
    ids = lambda r, **k: [x.id for x in plan(r, docs, **k).collect()]
    assert ids(SearchRequest("apple")) == [1, 4]
    assert ids(SearchRequest("AND")) == [4]
    assert ids(SearchRequest("?!")) == ids(SearchRequest("")) == []
    assert ids(SearchRequest("", Filters(tags=frozenset(["t"])))) == [1, 3, 4]
    assert ids(SearchRequest("", Filters(fm={"k": "1"}))) == [1]
    assert ids(SearchRequest("pie", Filters(frozenset(["en"]))), scope=["de"]) == []
    assert ids(SearchRequest("pie"), scope=["de"]) == [4]
    vectors = spark.createDataFrame([(2, [1.0, 0.0]), (4, [0.0, 1.0]), (4, [1.0, 1.0])], "id long, vector array<float>")
    assert ids(SearchRequest("apple", mode="hybrid", vector=[1, 0]), vectors=vectors) == [4, 1, 2]
    assert ids(SearchRequest("apple", mode="hybrid")) == [1, 4]
    for bad in ({"limit": 0}, {"limit": 501}, {"offset": 10_001}, {"mode": "x"}, {"query": "x" * 5000}):
        with pytest.raises(InvalidRequest):
            SearchRequest(**bad)
    with pytest.raises(Exception, match="dimension"):
        search.vector_scores(vectors, [1.0]).collect()


def test_pages(spark):
    docs = spark.range(10).select(F.col("id"), F.lit("c").alias("collection"), F.lit(False).alias("deleted"))
    seen, after = [], None
    while True:
        page = listing.keyset_page(docs, after, 3)
        got = [r.id for r in page.items.collect()]
        seen += got
        assert page.total.first().total == 10
        if not page.more.first().has_more:
            break
        after = got[-1]
    assert seen == list(range(10))
    with pytest.raises(InvalidRequest):
        listing.page(docs, 3, offset=1, cursor=2)
    odd = spark.createDataFrame([("a%b/c",), ("axb/c",), ("a_b",)], "path string")
    assert rows(odd.where(listing.under(F.col("path"), "a%")), "path") == [("a%b/c",)]


def test_sync(spark):
    schema = "id string, collection string, path string, content_hash string, deleted boolean, updated_at timestamp"
    side = lambda *r: spark.createDataFrame([(i, "c", i, h, d, datetime(2020, 1, u)) for i, h, d, u in r], schema)
    local = side(("a", "1", False, 1), ("b", "1", True, 1), ("c", "2", False, 2), ("d", "1", False, 1), ("e", "1", False, 1))
    remote = side(("b", "2", False, 9), ("c", "1", False, 2), ("d", "2", False, 5), ("e", "1", False, 7), ("f", "1", False, 1))
    assert rows(sync.compared(local, remote), "id", "winner") == [("a", "local"), ("b", "local"), ("c", "local"), ("d", "remote"), ("e", "both"), ("f", "remote")]
    assert sync.compared(sync.converged(local, remote), sync.converged(remote, local)).where("NOT same").count() == 0


def test_overlay_and_feed(spark):
    writes = spark.createDataFrame([("a", 1, 1, True), ("a", 2, 2, False), ("b", 3, 3, True), ("c", 4, 0, False)], "id string, sequence long, s int, projected boolean").withColumn("at", F.timestamp_seconds("s"))
    assert rows(changes.overlay(writes.drop("s"), F.timestamp_seconds(F.lit(301))), "id", "sequence") == [("a", 2), ("b", 3)]
    good, bad = changes.undecodable(spark.createDataFrame([('{"id": 1}',), ("{",)], "value string"), "id long")
    assert rows(good, "id") == [(1,)] and rows(bad, "value") == [("{",)]


def test_lease(spark):
    o = spark.createDataFrame([(i, T0, False, None, None, None) for i in range(4)], "id long, created_at timestamp, dead_lettered boolean, lease_owner string, lease_token string, lease_expires_at timestamp")
    first = changes.claimed(o, "w1", F.lit("t1"), now(), 2)
    second = changes.claimed(first, "w2", F.lit("t2"), now(), 10)
    assert rows(second, "id", "lease_owner") == [(0, "w1"), (1, "w1"), (2, "w2"), (3, "w2")]
    later = changes.claimed(second, "w2", F.lit("t3"), now() + F.expr("INTERVAL 31 SECONDS"), 10)
    assert rows(later, "lease_token") == [("t3",)] * 4


def test_files(spark, tmp_path):
    for name, content in {"a.md": "x", "sub/B.MD": "é", ".obsidian/c.md": "no", "bad .md": "y", "café.md": "c", "empty.md": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    good, bad = files.notes(spark, str(tmp_path))
    assert rows(good, "id", "content") == [("a", "x"), ("café", "c"), ("empty", ""), ("sub/B", "é")]
    assert rows(bad, "path") == [("bad .md",)]
    assert rows(files.import_candidates(spark, str(tmp_path)), "id") == [("a",), ("bad",), ("café",), ("empty",), ("sub/B",)]
    with pytest.raises(Unsupported):
        files.PlainDirectory(spark, str(tmp_path)).upsert()


def test_blobs(spark):
    data = spark.createDataFrame([(b"a",), (b"a",), (b"",)], "bytes binary")
    none = spark.createDataFrame([], "hash string, algorithm string, size long, bytes binary")
    held = blobs.put(none, data)
    assert held.count() == 1 and blobs.put(held, data).count() == 1
    assert blobs.verified(held, F.lit(-1)).first().ok and not blobs.verified(held, F.lit(5)).first().ok


def test_requests_reserve_anew_after_their_time_to_live(spark):
    rows = [("a", "p", 0, True), ("a", "p", 1, True), ("a", "q", 24, True), ("a", "q", 25, True), ("a", "q", 26, True), ("a", "p", 49, True), ("a", "p", 50, False), ("a", "p", 51, True)]
    rows = [(n, k, p, T0 + timedelta(hours=h), c) for n, (k, p, h, c) in enumerate(rows)]
    got = store.deduplicated_requests(spark.createDataFrame(rows, "n int, key string, payload_hash string, at timestamp, completed boolean"), ties=["n"])
    assert [r.outcome for r in got.orderBy("n").collect()] == ["reserve", "replay", "conflict", "reserve", "replay", "conflict", "reserve", "in-flight"]


def test_requests_beyond_capacity_and_at_one_time(spark):
    rows = [("a", "p", True), ("a", "q", True), ("b", "p", False), ("c", "p", False), ("a", "p", True), ("b", "p", True), ("d", "p", True)]
    rows = [(n, k, p, T0, c) for n, (k, p, c) in enumerate(rows)]
    got = store.deduplicated_requests(spark.createDataFrame(rows, "n int, key string, payload_hash string, at timestamp, completed boolean"), capacity=2, ties=["n"])
    assert [r.outcome for r in got.orderBy("n").collect()] == ["reserve", "conflict", "reserve", "reserve", "conflict", "in-flight", "conflict"]
