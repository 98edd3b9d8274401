"""Segments, the stored state, and the drain that applies."""

import math
import random
import re
from datetime import datetime, timedelta

import pytest
from mossgraph.operators import store
from mossgraph.operators.index import StoredIndex
from mossgraph.operators.segments import Conflict, Spec, Tables, among, part_of, parts_for
from mossgraph.operators.stored import Store
from mossgraph.plans.search import SearchRequest, answer, plan
from mossgraph.shared import shared_folder
from mossgraph.streaming.projection import DrainFailed, Projection, applied
from pyspark.sql import functions as F

INDEXED = "id string, collection string, tags array<string>, fm_terms array<string>, title string, content string"
STORED = "id string, collection string, path string, content string, content_hash string, revision string, updated_at timestamp, deleted boolean"


# segments


def test_two_writers_and_readers_of_old_versions(spark):
    t = Tables(spark, shared_folder(spark), {"a": Spec("k"), "b": Spec("k", "part")})
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    first = t.commit(t.manifest(), t.stage("a", rows(("x", 1), ("y", 2))))
    base = t.manifest()
    t.commit(base, t.stage("a", rows(("x", 3)), rows(("x", 0))))
    with pytest.raises(Conflict):
        t.commit(base, t.stage("a", rows(("z", 9))))
    parted = rows(*((f"k{i}", i) for i in range(20))).withColumn("part", part_of(F.col("k"), 4))
    now = t.apply(lambda m: t.stage("b", parted, parts=4))
    assert now.version == t.version() == 3 and t.manifest() == now
    assert sorted(map(tuple, t.read(now, "a").collect())) == [("x", 3), ("y", 2)] and sorted(map(tuple, t.read(first, "a").collect())) == [("x", 1), ("y", 2)]
    pruned = t.read(now, "b", lambda r, s: r.where(F.col("part") == part_of(F.lit("k7"), s.parts)))
    assert "k7" in {r.k for r in pruned.collect()} and pruned.count() < 20
    assert parts_for(1) == parts_for(200_000) == 1 and parts_for(10**6) == 8 and parts_for(10**15) == 1024
    t.vacuum()
    assert t.read(t.manifest(), "a").count() == 2
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        t.read(first, "a").count() and t.manifest(1)


def test_a_folder_without_a_scheme(spark):
    tables = Tables(spark, shared_folder(spark).removeprefix("file://"), {"t": Spec("id")})
    tables.commit(tables.manifest(), tables.stage("t", spark.range(3)))
    base = tables.manifest()
    tables.commit(base, tables.stage("t", spark.range(3, 5)))
    with pytest.raises(Conflict):
        tables.commit(base, tables.stage("t", spark.range(5, 6)))
    assert sorted(r.id for r in tables.read(tables.manifest(), "t").collect()) == [0, 1, 2, 3, 4]


def test_merging_keeps_what_counts(spark):
    t = Tables(spark, shared_folder(spark), {"a": Spec("k")})
    r, have = random.Random(2), {}
    for n in range(9):
        new, gone = {f"k{r.randrange(12)}": n * 100 + i for i in range(3)}, {f"k{r.randrange(12)}"}
        have = {k: v for k, v in have.items() if k not in gone} | new
        t.apply(lambda m, new=new, gone=gone: t.stage("a", spark.createDataFrame(list(new.items()), "k string, v int"), spark.createDataFrame([(k,) for k in gone | set(new)], "k string")))
    old = t.manifest()
    now = t.compact("a", fanout=3)
    assert len(now.segments["a"]) < 3 <= len(old.segments["a"])
    assert dict(map(tuple, t.read(now, "a").collect())) == have == dict(map(tuple, t.read(old, "a").collect()))


def test_merging_beside_another_writer(spark):
    t = Tables(spark, shared_folder(spark), {"a": Spec("k")})
    for n in range(4):
        t.apply(lambda m, n=n: t.stage("a", spark.createDataFrame([(f"k{n}",)], "k string")))
    stage, late = t.stage, []

    def slow(*args):
        out = stage(*args)
        if not late:
            late.append(1)
            t.apply(lambda m: stage("a", spark.createDataFrame([("late",)], "k string")))
        return out

    t.stage = slow
    now = t.compact("a")
    assert len(now.segments["a"]) == 2 and {x.k for x in t.read(now, "a").collect()} == {"k0", "k1", "k2", "k3", "late"}


# index


def docs(spark, *rows):
    return spark.createDataFrame([(i, "c", tags, [], title, content) for i, tags, title, content in rows], INDEXED)


def test_ten_changes_equal_one_build(spark):
    r = random.Random(5)
    word = lambda: r.choice("red blue green sky sea sun moon".split())
    have, index = {}, StoredIndex(spark, shared_folder(spark), buckets=2)
    for step in range(10):
        new = {f"d{r.randrange(15)}": None for _ in range(4)}
        new = {i: (i, r.sample(["red", "x"], r.randrange(3)), r.choice([None, word()]), " ".join(word() for _ in range(r.randrange(6)))) for i in new}
        gone = [i for i in r.sample(sorted(have), min(2, len(have))) if i not in new]
        have = {i: d for i, d in (have | new).items() if i not in gone}
        index.add(docs(spark, *new.values()), spark.createDataFrame([(g,) for g in gone], "id string"))
    many = index.segments
    index.compact()
    once = StoredIndex(spark, shared_folder(spark), buckets=1).add(docs(spark, *have.values()))
    assert many == 10 and index.segments < 4
    assert sorted(map(tuple, index.statistics().collect())) == sorted(map(tuple, once.statistics().collect()))
    for query in ("red moon", "x", "sun"):
        got, expected = ({x.id: x.score for x in i.scores(query).collect()} for i in (index, once))
        assert got.keys() == expected.keys() and all(math.isclose(got[i], s) for i, s in expected.items())


def test_an_add_reads_lengths_of_its_ids_only(spark):
    index = StoredIndex(spark, shared_folder(spark), buckets=8).add(docs(spark, *((f"d{i}", [], None, f"text {i}") for i in range(40))))
    gone = spark.createDataFrame([("d3",)], "id string")
    had = index.tables.read(index.tables.manifest(), "documents", lambda rows, s: among(rows.select("id", "lengths", "part"), gone, "id", "part", s))
    text = had._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: (\S+)", text)
    assert read == ["struct<id:string,lengths:struct<title:int,content:int,tags:int>>"] and re.search(r"PartitionFilters: \[[^\]]*part#", text) and had.count() == 1


def test_empty_corpora_and_texts(spark):
    none = docs(spark, ("a", [], None, "x")).limit(0)
    index = StoredIndex(spark, shared_folder(spark)).add(none)
    assert answer(SearchRequest("word"), index).count() == 0 and index.documents().count() == 0 and index.statistics().count() == 0
    some = docs(spark, ("a", [], None, "alpha beta"), ("b", [], None, ""), ("c", [], None, "..."), ("d", [], None, "alpha"))
    index.add(some)
    by_scan = {r.id: r.score for r in plan(SearchRequest("alpha"), some, text="content").collect()}
    by_index = {r.id: r.score for r in answer(SearchRequest("alpha"), index).collect()}
    assert by_scan.keys() == by_index.keys() == {"a", "d"} and all(math.isclose(by_scan[i], s) for i, s in by_index.items())
    assert StoredIndex(spark, index.folder).add(none, some.select("id")).documents().count() == 0


def test_ideographs_are_highlighted(spark):
    text = "前書き" * 80 + "深山の中で alpha" + "終" * 200
    index = StoredIndex(spark, shared_folder(spark)).add(docs(spark, ("a", [], None, text)))
    got = answer(SearchRequest("山 alpha"), index).first()
    marked = [got.snippet[h.start : h.end] for h in got.highlights]
    assert marked == ["山", "alpha"]


# transactions


def records(spark, *rows):
    d = spark.createDataFrame([(i, "v", f"{i}.md", c, f"h-{c}", f"r-{c}", datetime(2024, 1, 1), gone) for i, c, gone in rows], STORED)
    revisions = d.select(F.col("id").alias("doc_id"), "revision", F.lit(None).cast("string").alias("author"), F.lit("init").alias("message"), "content_hash", "content", F.col("updated_at").alias("created_at"))
    edges = spark.sql("SELECT 'a' AS src, 'b' AS dst, 'links-to' AS rel, CAST(map() AS map<string,string>) AS props UNION ALL SELECT 'b', 'a', 'links-to', CAST(map() AS map<string,string>)")
    return store.State(d, revisions, edges, store._operation(d, "UPSERT").limit(0))


def at_once():
    return F.expr("timestamp'2030-01-01'")


def contents(made):
    return {r.id: (r.content, r.deleted) for r in made.state().documents.collect()}


def test_of_two_writers_of_an_id_one_gets_a_conflict(spark):
    made = Store(spark, shared_folder(spark))
    made.load(records(spark, ("a", "one", False), ("b", "two", False)))
    change = lambda content: spark.createDataFrame([("a", "v", content, "r-one")], "id string, collection string, content string, expected_revision string")
    others = []

    def first(state):
        if not others:  # another writer is faster
            others.append(made.commit(lambda s: store.upsert(s, change("theirs"), at_once())))
        return store.upsert(state, change("mine"), at_once())

    mine = made.commit(first)
    assert others[0].conflicts.count() == 0 and [tuple(c) for c in mine.conflicts.collect()] == [("a", "revision")]
    assert contents(made) == {"a": ("theirs", False), "b": ("two", False)} and mine.version == 3
    state = made.state()
    assert state.revisions.where("doc_id = 'a'").count() == 2 and [o.document_id for o in state.outbox.collect()] == ["a"]
    assert made.read("a").first().content == "theirs" and made.read("zz").count() == 0 and made.state(1).documents.where("content = 'one'").count() == 1


@pytest.mark.parametrize("step", ["documents", "revisions", "outbox", "commit"])
def test_a_failure_at_any_step_leaves_the_old_version(spark, monkeypatch, step):
    made = Store(spark, shared_folder(spark))
    made.load(records(spark, ("a", "one", False)))
    stage = made.tables.stage

    def broken(table, *args):
        if table == step:
            raise OSError(step)
        return stage(table, *args)

    monkeypatch.setattr(made.tables, "stage", broken)
    if step == "commit":
        monkeypatch.setattr(made.tables, "_take", lambda m: (_ for _ in ()).throw(OSError(step)))
    with pytest.raises(OSError, match=step):
        made.commit(lambda s: store.delete(s, spark.sql("SELECT 'a' AS id"), at_once()))
    monkeypatch.undo()
    assert made.tables.version() == 1 and contents(made) == {"a": ("one", False)} and made.state().outbox.count() == 0


def test_delete_restore_rename_and_edges(spark):
    made = Store(spark, shared_folder(spark))
    made.load(records(spark, ("a", "one", False), ("b", "two", False)))
    made.commit(lambda s: store.delete(s, spark.sql("SELECT 'a' AS id UNION ALL SELECT 'q'"), at_once()))
    assert contents(made)["a"] == ("one", True) and made.read("a").count() == 0 and made.read("a", True).count() == 1
    again = made.commit(lambda s: store.restore(s, spark.sql("SELECT 'a' AS id"), at_once()))
    assert contents(made)["a"] == ("one", False) and again.conflicts.count() == 0
    out = made.commit(lambda s: store.rename(s, spark.sql("SELECT 'a' AS old_id, 'c/d' AS new_id UNION ALL SELECT 'zz', 'y'"), at_once()))
    assert [tuple(c) for c in out.conflicts.collect()] == [("zz", "not live")]
    state = made.state()
    assert contents(made) == {"b": ("two", False), "c/d": ("one", False)} and sorted((e.src, e.dst) for e in state.edges.collect()) == [("b", "c/d"), ("c/d", "b")]
    assert {r.doc_id: r.n for r in state.revisions.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {"b": 1, "c/d": 4}
    assert sorted((o.document_id, o.kind) for o in state.outbox.collect()) == [("a", "DELETE"), ("a", "UPSERT"), ("c/d", "UPSERT")]
    made.settle(state.outbox.select("id", (F.col("document_id") == "a").alias("ok")), at_once())
    assert [(o.document_id, o.attempts) for o in made.state().outbox.collect()] == [("c/d", 1)]
    made.replace_edges(state.edges.where("src = 'b'").withColumn("dst", F.lit("x")), spark.sql("SELECT 'b' AS id UNION ALL SELECT 'c/d'"))
    made.compact()
    assert [(e.src, e.dst) for e in made.state().edges.collect()] == [("b", "x")] and contents(made) == {"b": ("two", False), "c/d": ("one", False)}


def test_a_store_from_nothing(spark):
    made = Store(spark, shared_folder(spark))
    assert made.state().documents.count() == 0
    made.commit(lambda s: store.upsert(s, spark.sql("SELECT 'a' AS id, 'v' AS collection, 'new' AS content"), at_once()))
    assert contents(made) == {"a": ("new", False)} and made.state().revisions.count() == 1 and made.state().outbox.count() == 1


# the drain


def canonical(spark, *rows):
    return spark.createDataFrame([(i, "v", c, f"h{c}", gone) for i, c, gone in rows], "id string, collection string, content string, content_hash string, deleted boolean")


def operations(spark, *rows):
    return spark.createDataFrame([(f"{i}|{n}", i, f"h{c}", kind, datetime(2024, 1, 1) + timedelta(seconds=n), 0, False) for n, (i, c, kind) in enumerate(rows)], "id string, document_id string, content_hash string, kind string, created_at timestamp, attempts int, dead_lettered boolean")


def test_a_batch_is_applied_once_and_failures_come_back(spark):
    p, at = Projection(spark, shared_folder(spark)), datetime(2025, 1, 1)
    docs_ = canonical(spark, ("n/a", "to [[b]] and [[n/c]]", False), ("b", "beta", False), ("bad", None, False), ("old", "x", True))
    ops = operations(spark, ("n/a", "to [[b]] and [[n/c]]", "UPSERT"), ("b", "stale", "UPSERT"), ("bad", None, "UPSERT"), ("b", "beta", "UPSERT"))
    ops = ops.withColumn("content_hash", F.when(F.col("document_id") == "bad", None).otherwise(F.col("content_hash")))
    docs_ = docs_.withColumn("content_hash", F.when(F.col("id") == "bad", None).otherwise(F.col("content_hash")))
    assert p.apply(ops, docs_, "s", 0, at) and p.done("s") == 0
    assert {r.id for r in p.index.documents().collect()} == {"n/a", "b"} and [(e.src, e.dst) for e in p.edges().collect()] == [("n/a", "b")]
    waits = p.waiting().collect()
    assert [(w.document_id, w.attempts, w.dead_lettered, w.not_before) for w in waits] == [("bad", 1, False, at + timedelta(seconds=1))]
    version = p.tables.version()
    assert not p.apply(ops, docs_, "s", 0, at) and p.tables.version() == version  # a repeated batch changes nothing
    none = ops.limit(0)
    assert p.apply(none, docs_, "s", 1, at) and p.waiting().first().attempts == 1  # not due
    mended = docs_.withColumn("content", F.coalesce("content", F.lit("gamma [[b]]")))
    assert p.apply(none, mended, "s", 2, at + timedelta(seconds=1)) and p.waiting().count() == 0
    assert {r.id for r in p.index.scores("gamma").collect()} == {"bad"} and p.edges().count() == 2


def test_operations_are_given_up(spark):
    p, at = Projection(spark, shared_folder(spark)), datetime(2025, 1, 1)
    docs_ = canonical(spark, ("bad", None, False))
    for n in range(6):
        p.apply(operations(spark, ("bad", None, "UPSERT")).limit(0 if n else 1), docs_, "s", n, at + timedelta(minutes=2 * n))
    last = p.waiting().first()
    assert last.attempts == 5 and last.dead_lettered and p.index.documents().count() == 0


def test_links_are_repaired_when_documents_come_and_go(spark):
    p, at = Projection(spark, shared_folder(spark)), datetime(2025, 1, 1)
    a, c = ("n/a", "to [[c]] and [[b]]", False), ("x/c", "see", False)
    p.apply(operations(spark, (*a[:2], "UPSERT")), canonical(spark, a), "s", 0, at)
    assert p.edges().count() == 0
    p.apply(operations(spark, (*c[:2], "UPSERT")), canonical(spark, a, c), "s", 1, at)
    assert [(e.src, e.dst) for e in p.edges().collect()] == [("n/a", "x/c")]
    p.apply(operations(spark, (*c[:2], "DELETE")), canonical(spark, a, (*c[:2], True)), "s", 2, at)
    assert p.edges().count() == 0 and {r.id for r in p.index.documents().collect()} == {"n/a"}
    p.compact()
    assert p.edges().count() == 0 and p.index.scores("to").count() == 1


def test_a_failed_batch_does_nothing_and_is_run_again(spark, tmp_path, monkeypatch):
    p = Projection(spark, shared_folder(spark))
    docs_ = canonical(spark, ("a", "alpha [[b]]", False), ("b", "beta", False))
    for n, rows in enumerate([[("a", "alpha [[b]]", "UPSERT")], [("b", "beta", "UPSERT")]]):
        operations(spark, *rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = lambda: spark.readStream.schema(operations(spark, ("a", "x", "UPSERT")).schema).parquet(str(tmp_path / "in" / "*"))
    run = lambda: applied(stream(), p, lambda: docs_, str(tmp_path / "state"), lambda: datetime(2025, 1, 1)).awaitTermination()
    monkeypatch.setattr(p.tables, "_take", lambda m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        run()
    assert p.tables.version() == 0 and p.edges() is None
    monkeypatch.undo()
    run()
    run()
    assert {r.id for r in p.index.documents().collect()} == {"a", "b"} and p.edges().count() == 1 and p.done("outbox") == 0


def test_reconcile_reads_what_differs(spark):
    p = Projection(spark, shared_folder(spark))
    files = {f"n{i}": f"text {i} [[n{(i + 1) % 40}]]" for i in range(40)}

    def scan():
        d = canonical(spark, *((i, c, False) for i, c in files.items()))
        return d.select("id", F.col("content_hash").alias("change_token")), d

    counts = lambda r: {x.change: x.n for x in r.collect()}
    assert counts(p.reconcile(*scan())) == {"added": 40} and p.edges().count() == 40
    version = p.tables.version()
    assert counts(p.reconcile(*scan())) == {"unchanged": 40} and p.tables.version() == version  # nothing is written
    files |= {f"n{i}": f"changed {i}" for i in range(5, 15)}
    del files["n30"]
    files["bad"] = None
    with pytest.raises(DrainFailed):
        p.reconcile(*scan(), drain=lambda: False)
    assert p.tables.version() == version
    assert counts(p.reconcile(*scan(), drain=lambda: True)) == {"unchanged": 29, "updated": 10, "removed": 1, "failed": 1}
    now = p.tables.manifest()
    last = p.tables.read(now, "documents", segments=now.segments["documents"][-1:])
    assert {r.id for r in last.collect()} == {f"n{i}" for i in range(5, 15)}  # only those were read
    assert p.edges().count() == 40 - 1 - 10 - 1 and {r.id for r in p.index.scores("changed").collect()} == {f"n{i}" for i in range(5, 15)}
    files["bad"] = "mended"
    assert counts(p.reconcile(*scan())) == {"unchanged": 39, "added": 1} and p.index.documents().count() == 40
