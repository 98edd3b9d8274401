import math
import random

import pytest
from mossgraph import model
from mossgraph.functions.tokenizers import embedder_udf, mean_vectors
from mossgraph.operators import changes, graph, metrics, rebuild, store, sync
from mossgraph.operators.index import StoredIndex
from mossgraph.operators.search import Filters
from mossgraph.plans.search import SearchRequest, answer, total
from mossgraph.shared import shared_folder, written
from mossgraph.sources import files
from pyspark.sql import functions as F

DOCS = "id string, collection string, tags array<string>, fm_terms array<string>, title string, content string"


def made(spark, *rows):
    return spark.createDataFrame([(i, c, tags, [], title, content) for i, c, tags, title, content in rows], DOCS)


def brute_scores(docs, words, wanted=lambda d: True):
    """BM25 by the book over title, content and tags."""
    terms = lambda s: "".join(ch if ch.isalnum() else " " for ch in (s or "").lower()).split()
    out = {}
    for field in ("title", "content", "tags"):
        of = {d[0]: (d[2] if field == "tags" else terms(d[3] if field == "title" else d[4])) for d in docs}
        held = {i: t for i, t in of.items() if t}
        if not held:
            continue
        average = sum(map(len, held.values())) / len(held)
        for w in words:
            df = sum(w in t for t in held.values())
            for i, t in held.items():
                if w in t:
                    tf, length = t.count(w), 1 if field == "tags" else len(t)
                    out[i] = out.get(i, 0) + math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * length / average))
    return {i: s for i, s in out.items() if wanted(next(d for d in docs if d[0] == i))}


def test_stored_index_through_changes(spark):
    r = random.Random(3)
    word = lambda: r.choice("red blue green sky sea sun moon".split())
    doc = lambda i: (i, r.choice("ab"), r.sample(["red", "blue", "x"], r.randrange(3)), r.choice([None, word() + " " + word()]), " ".join(word() for _ in range(r.randrange(0, 12))))
    have = {f"d{k}": doc(f"d{k}") for k in range(30)}
    index = StoredIndex(spark, shared_folder(spark), buckets=4).add(made(spark, *have.values()))
    for step in range(3):
        if step:
            new, gone = {f"d{k}": doc(f"d{k}") for k in r.sample(range(40), 8)}, r.sample(sorted(have), 3)
            gone = [g for g in gone if g not in new]
            index.add(made(spark, *new.values()), spark.createDataFrame([(g,) for g in gone], "id string"))
            have = {k: v for k, v in (have | new).items() if k not in gone}
        assert {d.id for d in index.documents().collect()} == set(have)
        for keep, wanted in ((None, lambda d: True), (Filters(frozenset(["a"])).predicate(), lambda d: d[1] == "a")):
            got = {x.id: x.score for x in index.scores("RED, moon red", keep).collect()}
            expected = brute_scores(list(have.values()), ["red", "moon"], wanted)
            assert got.keys() == expected.keys() and all(math.isclose(got[i], s) for i, s in expected.items())
    assert index.scores("...").count() == 0


def test_answer(spark):
    long = "x " * 100 + "the Needle is here " + "y " * 100
    index = StoredIndex(spark, shared_folder(spark)).add(made(spark, ("a", "v", ["needle"], None, long), ("b", "v", [], "Needle", "short needle text"), ("c", "w", [], None, "nothing"), ("d", "v", [], None, "old needle")))
    pending = spark.createDataFrame([("d", "v", [], [], None, "now without it", False), ("e", "v", [], [], None, "A fresh NEEDLE " * 20, False), ("c", "w", [], [], None, "", True)], DOCS + ", deleted boolean")
    page = answer(SearchRequest("needle", limit=2), index, pending=pending).orderBy(F.desc("score"), "id").collect()
    assert page[0].id == "e" and page[0].snippet == ("A fresh NEEDLE " * 20)[:160] and page[0].has_more and page[0].highlights[0].start == 8
    rest = answer(SearchRequest("needle", limit=2, offset=2), index, pending=pending).collect()
    both = {r.id: r for r in [*page[1:], *rest]}
    assert set(both) == {"a", "b"} and both["b"].snippet == "short needle text" and both["b"].highlights == [] and not rest[0].has_more
    at = long.index("Needle")
    assert both["a"].snippet == long[at - 40 : at + 160] and [tuple(h) for h in both["a"].highlights] == [(40, 46)]
    assert answer(SearchRequest("needle", Filters(frozenset(["w"]))), index).count() == 0
    assert [r.id for r in answer(SearchRequest(filters=Filters(frozenset(["w"]))), index).collect()] == ["c"]
    assert answer(SearchRequest(), index).count() == 0
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    assert {r.id for r in answer(SearchRequest("needle", mode="hybrid", vector=[0.0, 1.0]), index, vectors).collect()} == {"a", "b", "c", "d"}
    assert [r.id for r in answer(SearchRequest("", mode="vector", vector=[0.0, 1.0], limit=1), index, vectors).collect()] == ["c"]
    assert total(index).first().n == 4 and total(index, pending=pending).first().n == 4 and total(index, Filters(frozenset(["w"])), pending).first().n == 0


def test_traverse_in_order_of_discovery(spark):
    e = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "z"), ("c", "d"), ("c", "b"), ("b", "a"), ("z", "y")], "src string, dst string").withColumn("rel", F.lit("links-to"))
    got = graph.traverse(e.unionByName(e), ["a"], 10).orderBy("depth", "path").collect()
    assert [(r.id, r.depth) for r in got] == [("b", 1), ("c", 1), ("a", 2), ("z", 2), ("d", 2), ("y", 3)]
    many = spark.range(1500).select(F.lit("s").alias("src"), F.format_string("n%04d", "id").alias("dst"), F.lit("links-to").alias("rel"))
    assert graph.traverse(many, ["s"], 1).agg(F.count("*"), F.max("id")).first()[:] == (1000, "n0999")
    assert graph.traverse(many, ["s"], 1, fanout=None).count() == 1500
    assert graph.traverse(e, ["a"], 2, visible=spark.sql("SELECT 'z' AS id")).first().id == "z"


def test_relations():
    expected = {"links-to": "links-to link links wikilink backlink", "references": "references reference ref", "embeds": "embeds embed attachment file files", "mentions": "mentions mention author"}
    for name, others in expected.items():
        assert all(model.relation(o) == name for o in others.split())
    for bad in ("refs", "links_to", "", "Links"):
        with pytest.raises(model.InvalidRequest):
            model.relation(bad)


def test_rebuild_keeps_the_old_state_when_it_fails(spark):
    folder = shared_folder(spark)
    note = lambda *rows: spark.createDataFrame(rows, "id string, content string").withColumn("collection", F.lit("v"))
    assert rebuild.rebuild(note(("a", "[[b]]"), ("b", "[[a]] [[c]]"), ("c", "word")), folder).first()[:] == (3, 3, 0)
    with pytest.raises(rebuild.RebuildFailed):
        rebuild.rebuild(note(("a", "[[b]]"), ("b", None)), folder)
    assert rebuild.current(spark, folder) == 0 and rebuild.edges(spark, folder).count() == 3
    assert rebuild.rebuild(note(("a", "[[b]]"), ("c", "other")), folder).first()[:] == (2, 0, 1)
    assert rebuild.edges(spark, folder).count() == 0 and {r.id for r in rebuild.index(spark, folder).scores("other").collect()} == {"c"}


def test_repaired_and_edge_changes(spark):
    parsed = spark.createDataFrame([("n", [(0, "x", None, False)], [], None), ("m", [(0, "y", None, False)], [], None)], "id string, links array<struct<ordinal:int,target:string,label:string,embed:boolean>>, refs array<struct<ordinal:int,rel:string,target:string>>, author string")
    documents = spark.createDataFrame([("n",), ("m",), ("p/x",), ("p/y",)], "id string")
    changed = spark.createDataFrame([("p/x",)], "id string")
    before = graph.derived(parsed, documents.where("id <> 'p/x' AND id <> 'p/y'"))
    after = graph.repaired(before, parsed, documents, changed)
    assert [(r.src, r.dst) for r in after.collect()] == [("n", "p/x")]
    assert graph.repaired(before, parsed, documents, changed, spark.sql("SELECT 'n' AS id")).count() == 0
    more = graph.upserted(after, after.withColumn("props", F.create_map(F.lit("k"), F.lit("v"))).unionByName(after.withColumn("dst", F.lit("q"))))
    assert sorted((r.dst, r.props.get("k")) for r in more.collect()) == [("p/x", "v"), ("q", None)]
    assert [r.dst for r in graph.without(more, changed, "dst").collect()] == ["q"] and graph.without(more, spark.sql("SELECT 'n' AS id")).count() == 0


def test_links_of_one_form_are_put_together_in_their_note(spark):
    """Before any shuffle there is one row for each form; the first label counts, and one link that embeds is enough."""
    links = [(0, "p/x", "one", False), (1, "./p/x.md", "two", True), (2, "/x", None, False), (3, "x", "three", False), (4, None, None, True), (5, "none", None, True)]
    schema = "id string, links array<struct<ordinal:int,target:string,label:string,embed:boolean>>, refs array<struct<ordinal:int,rel:string,target:string>>, author string"
    parsed = spark.createDataFrame([("n", links, [(0, "references", "r"), (1, "embeds", "p/x"), (2, "embeds", "f")], "me"), ("n", links[1:2], [], ""), ("o", [], [], None)], schema)
    assert graph._drawn(parsed.limit(1)).count() == 3 + 4  # p/x, x and none; three stated and one mentioned
    got = sorted((r.src, r.dst, r.rel, r.props.get("label")) for r in graph.derived(parsed, spark.createDataFrame([("n",), ("p/x",)], "id string")).collect())
    assert got == [("n", "author/me", "mentions", None), ("n", "f", "embeds", None), ("n", "p/x", "embeds", None), ("n", "p/x", "links-to", "one"), ("n", "r", "references", None)]


def test_postings_are_counted_in_their_row(spark):
    """No shuffle but the one that deals them to the parts; rows that share an id are still summed up."""
    rows = [(1, "v", ["t", "t"], ["k"], "b a b", "x"), (2, "v", None, None, None, "\u4e2d\u4e2d a"), (3, "v", [], [], "", "")]
    docs = lambda r: spark.createDataFrame(r, "id long, collection string, tags array<string>, fm_terms array<string>, title string, content string")
    index = StoredIndex(spark, shared_folder(spark))
    posted = index._postings_of(docs(rows), True)
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()
    want = [("content", "a", 2, 3, 1), ("content", "x", 1, 1, 1), ("content", "\u4e2d", 2, 3, 2), ("tags", "t", 1, 1, 1), ("title", "a", 1, 3, 1), ("title", "b", 1, 3, 2)]
    assert sorted(map(tuple, posted.collect())) == sorted(want)
    index.add(docs([*rows, rows[0]]))
    assert {(r.field, r.term, r.id): r.tf for r in index.hits(["b", "x", "t"]).collect()} == {("title", "b", 1): 4, ("content", "x", 1): 2, ("tags", "t", 1): 2}


def test_percentiles_of_skewed_groups(spark):
    r = random.Random(1)
    rows = [(g, v) for g, n in (("a", 5000), ("b", 3), ("c", 1)) for v in [r.choice([1.0, 1.0, round(r.gauss(0, 9), 2)]) for _ in range(n)]] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for by, most in ((["g"], 1 << 20), (["g"], 100), ([], 1 << 20), ([], 100)):
        got = {(x["g"] if by else None): x for x in metrics.nearest_ranks(df, "v", (1, 50, 95, 100), by, buckets=16, most=most).collect()}
        for key in ("a", "b", "c") if by else (None,):
            values = sorted(v for g, v in rows if v is not None and key in (g, None))
            for p in (1, 50, 95, 100):
                assert got[key][f"p{p}"] == values[max(1, math.ceil(len(values) * p / 100)) - 1]
            assert got[key].max == values[-1]
        assert "d" not in got
    assert metrics.nearest_ranks(df.limit(0), "v").count() == 0


def test_mean_vectors_and_embedder(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [float("nan"), 1.0]), (3, [5.0, 6.0])]
    got = {x.k: x.vector for x in mean_vectors(spark.createDataFrame(rows, "k int, vector array<double>"), "k").collect()}
    assert got == {1: [2.0, 3.0], 2: None, 3: [5.0, 6.0]}
    embed = embedder_udf(lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert [x.v for x in spark.createDataFrame([("ab",), (None,)], "t string").select(embed("t").alias("v")).collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_vanished_and_scoped(spark):
    docs = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "id string, deleted boolean")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r.id for r in changes.vanished(ids("b"), ids("a", "a", "b", "c", "zz"), docs).collect()] == ["a"]
    outbox = spark.sql("SELECT * FROM VALUES ('1', 'a', timestamp'2020-01-01', 0, false), ('2', 'b', timestamp'2020-01-02', 1, false) AS o(id, document_id, created_at, attempts, dead_lettered)")
    assert metrics.scoped_backlog(outbox, ids("b")).first()[:2] == (1, 1)


def test_event_documents(spark):
    rows = spark.createDataFrame([("/v/a/b.md",), ("vault/c.md",), ("d.md",), ("/other/e.md",), ("f.txt",)], "p string")
    assert [r[0] for r in rows.select(files.event_document(F.col("p"), "/v", "vault")).collect()] == ["a/b", "c", "d", None, None]


def test_upsert_refuses_a_held_path(spark):
    d = spark.createDataFrame([("a", "v", "b.md", "x", "h", "r", None, False)], "id string, collection string, path string, content string, content_hash string, revision string, updated_at timestamp, deleted boolean")
    history = spark.createDataFrame([], "doc_id string, revision string, author string, message string, content_hash string, content string, created_at timestamp")
    s = store.State(d, history, spark.createDataFrame([], model.EDGES), store._operation(d, "UPSERT").limit(0))
    out = store.upsert(s, spark.sql("SELECT 'b' AS id, 'v' AS collection, 'new' AS content UNION ALL SELECT 'c', 'v', 'new'"), F.expr("timestamp'2030-01-01'"))
    assert [r[:] for r in out.conflicts.collect()] == [("b", "path held")] and {r.id for r in out.documents.collect()} == {"a", "c"}
    wrong = store.upsert(s, spark.sql("SELECT 'a' AS id, 'v' AS collection, 'new' AS content, 'other' AS expected_hash"), F.expr("timestamp'2030-01-01'"))
    assert [r[:] for r in wrong.conflicts.collect()] == [("a", "content hash")]
    right = store.upsert(s, spark.sql("SELECT 'a' AS id, 'v' AS collection, 'new' AS content, 'h' AS expected_hash"), F.expr("timestamp'2030-01-01'"))
    assert right.documents.first().content == "new" and right.outbox.count() == 1 and right.revisions.count() == 1


def test_late_ids_count_when_they_come(spark, tmp_path):
    from mossgraph.streaming import drain

    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    for n, rows in enumerate([[(5, 1, True), (6, 1, True)], [(2, 1, True)], [(7, 1, False), (8, 1, True)]]):
        spark.createDataFrame(rows, "id long, document_id long, failed boolean").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema("id long, document_id long, failed boolean").parquet(str(tmp_path / "in" / "*"))
        drain.drained(drain.attempts(stream), f"{out}/rows", f"{out}/state", "update").awaitTermination()
        last = drain.updated(spark, f"{out}/rows", drain.ATTEMPTS, ["document_id"]).first()
        assert (last.attempts, last.last_id) == [(2, 6), (3, 6), (1, 8)][n]


def test_feed_numbers_run_on(spark, tmp_path):
    from mossgraph.streaming import drain

    for n in range(3):
        spark.createDataFrame([(n * 10 + k,) for k in range(n + 1)], "id long").withColumn("at", F.timestamp_seconds("id")).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema("id long, at timestamp").parquet(str(tmp_path / "in" / "*"))
        drain.feed_to(stream, str(tmp_path / "feed"), str(tmp_path / "state"), ["at", "id"]).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "feed")).orderBy("sequence").collect()
    assert [(r.sequence, r.id) for r in got] == list(enumerate([0, 10, 11, 20, 21, 22], 1))


def test_windowed_counts(spark, tmp_path):
    from mossgraph.streaming import drain

    spark.sql("SELECT * FROM VALUES (timestamp'2020-01-01 00:00:01', 'a'), (timestamp'2020-01-01 00:00:59', 'a'), (timestamp'2020-01-01 00:01:01', 'b'), (timestamp'2020-01-01 01:00:00', 'z') AS e(at, kind)").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, kind string").parquet(str(tmp_path / "in"))
    drain.drained(drain.windowed_counts(stream, "at", "kind", "1 minute", "1 minute"), str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "o"))
    assert sorted((r.kind, r.n) for r in got.collect()) == [("a", 2), ("b", 1)]


def test_written(spark):
    df = written(spark.range(3))
    assert df.count() == 3 and df.inputFiles() and sync is not None
