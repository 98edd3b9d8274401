import pyarrow as pa
from mossgraph.functions import markdown
from mossgraph.functions.text import sha256
from mossgraph.operators import commands, store
from pyspark.sql import functions as F

NOW = "timestamp '2030-01-01 00:00:00'"
DOCUMENTS = "id string, collection string, path string, content string, content_hash string, revision string, updated_at timestamp, deleted boolean"
GIVEN = "id string, content string, collection string, path string, frontmatter string, tags array<string>, author string, message string, expected_revision string"


def given(spark, *rows):
    names = [c.split()[0] for c in GIVEN.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, "text" if n == "content" else None) for n in names) for r in rows], GIVEN)


def state(spark):
    d = spark.createDataFrame([("a", "kept", "a.md", "old", None, None, None, False)], DOCUMENTS).withColumns({"content_hash": sha256(F.col("content")), "revision": sha256(F.col("content")), "updated_at": F.expr(NOW)})
    revisions = d.select(F.col("id").alias("doc_id"), "revision", F.lit(None).cast("string").alias("author"), F.lit("x").alias("message"), "content_hash", "content", F.col("updated_at").alias("created_at"))
    edges = spark.createDataFrame([], "src string, dst string, rel string")
    return store.State(d, revisions, edges, store._operation(d, "UPSERT").limit(0))


def test_each_rule_has_its_reason(spark):
    long, bad = "é" * 65, "a\u0085b"
    cases = {
        None: [{"id": "x/y"}, {"id": "é", "collection": "é" * 64, "path": "é.md", "tags": ["t\n"], "author": "me", "message": "why", "content": ""}],
        "id": [{"id": i} for i in (None, "", " ", " x", "a\\b", "a//b", "../a", "a/./b", "c:/x", "x.MD", "a/ /b", bad, "é" * 257, "/a")],
        "collection": [{"id": "x", "collection": c} for c in ("", "\t", long, bad)],
        "path": [{"id": "x", "path": p} for p in ("", "y.md", "x", "x.md ", "/x.md")],
        "tags": [{"id": "x", "tags": t} for t in ([""], [long], [None], ["t"] * 65)],
        "author": [{"id": "x", "author": a} for a in (" ", long, bad)],
        "message": [{"id": "x", "message": m} for m in ("", "m" * 513, bad)],
        "revision": [{"id": "x", "expected_revision": r} for r in ("", bad, "r" * 513)],
        "content": [{"id": "x", "content": c} for c in (None, "é" * (1 << 19) + "x")],
    }
    for want, rows in cases.items():
        d = given(spark, *rows)
        assert [r[0] for r in d.select(commands.problem(d)).collect()] == [want] * len(rows), want


def test_the_block_as_it_was_written_stays(spark):
    one = commands.rendered_one
    assert one("---\r\nb: [1,  2]\r\na: x\r\n---\r\nbody\r\n", None) == ("---\nb: [1,  2]\na: x\n---\nbody\n", None, None)
    assert one("---\n---\nbody", None) == ("body", None, None) and one("", None) == ("", None, None) and one("plain", None)[0] == "plain"
    kept, degraded, refused = one("---\na: [\n---\nbody", None)
    assert kept == "---\na: [\n---\nbody" and degraded and not refused
    assert one("---\na: x\n---\nbody", '{"tags": ["t"], "title": "new"}') == ("---\ntitle: new\ntags:\n  - t\n---\nbody", None, None)
    deep = "[" * 9 + "]" * 9
    for bad in ("[1", "[]", '{"title": 1}', f'{{"a": {deep}}}', '{"a": "' + "x" * 4097 + '"}', '{"a": [' + ",".join("1" * 65) + "]}", "{" + ",".join(f'"k{i}": 1' for i in range(65)) + "}"):
        assert one("body", bad)[0] is None and one("body", bad)[2].startswith("frontmatter"), bad


def test_commands_are_applied_and_refused(spark):
    sent = given(spark, {"id": "a", "content": "---\r\nk: v\r\n---\r\nnew"}, {"id": "b"}, {"id": "b", "content": "other"}, {"id": "c", "frontmatter": "{}"}, {"id": "d", "frontmatter": "?"}, {"id": "e", "collection": ""})
    ready = commands.prepared(sent, state(spark).documents)
    assert sorted((r.id, r.created) for r in ready.collect()) == [("a", False), ("b", True), ("b", True), ("c", True), ("d", True), ("e", True)]
    made = commands.upsert(state(spark), ready, F.expr(NOW))
    want = "---\nk: v\n---\nnew"
    docs = {r.id: r for r in made.documents.withColumn("same", (F.col("revision") == sha256(F.col("content"))) & (F.col("revision") == F.col("content_hash"))).collect()}
    assert docs.keys() == {"a", "c"} and docs["a"].content == want and docs["a"].collection == "kept" and docs["c"].collection == "vault" and all(r.same for r in docs.values())
    assert sorted((r.id, r.reason.split(":")[0]) for r in made.conflicts.collect()) == [("b", "repeated"), ("b", "repeated"), ("d", "frontmatter"), ("e", "collection")]
    again = commands.upsert(made, commands.prepared(given(spark, {"id": "a", "content": want}, {"id": "c", "collection": "another", "content": "z"}), made.documents), F.expr(NOW))
    assert {r.id: r.content for r in again.documents.collect()} == {"a": want, "c": "text"} and [(r.id, r.reason) for r in again.conflicts.collect()] == [("c", "collection")]


def test_a_batch_is_rendered_in_chunks():
    sizes = []

    def made(a):
        sizes.append(len(a))
        return pa.array(a, pa.string())

    given = pa.array([str(i) for i in range(1000)])
    assert markdown.in_chunks(made, given) == given and max(sizes) == markdown.CHUNK and sum(sizes) == 1000
    assert len(markdown.in_chunks(made, given.slice(0, 0))) == 0
