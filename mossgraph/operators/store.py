"""Writes as new snapshots: upserts with preconditions, tombstones, restores, renames, history and the outbox.

A change set is a DataFrame with one row per id at most. A result is the next state of each table, and
conflicts are rows. Timestamps come in as literal columns, so a replay gives the same rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sha256
from ..functions.markdown import retargeted
from ..functions.text import suffixes

DOC = ["id", "collection", "path", "content", "content_hash", "revision", "updated_at", "deleted"]
REV = ["doc_id", "revision", "author", "message", "content_hash", "content", "created_at"]
OPS = ["id", "document_id", "revision", "content_hash", "kind", "created_at", "attempts", "dead_lettered"]


@dataclass(frozen=True)
class Delta:
    """What a change does to a state: documents that come or take the place of their ids' rows, ids that go, and ids that move (old_id, new_id)."""

    changed: DataFrame
    kind: str
    message: str
    gone: DataFrame | None = None
    moves: DataFrame | None = None


@dataclass(frozen=True)
class State:
    documents: DataFrame
    revisions: DataFrame
    edges: DataFrame
    outbox: DataFrame
    conflicts: DataFrame | None = None  #: id, reason
    delta: Delta | None = None  #: what made it of the state before


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def next_timestamp(now: Column, document: Column, latest: Column) -> Column:
    """Strictly later than what the history has: a millisecond after the greatest of the three."""
    return F.greatest(now, document, latest) + F.expr("INTERVAL '0.001' SECOND")


def _operation(changed: DataFrame, kind: str, at: str = "updated_at") -> DataFrame:
    return changed.select(F.concat_ws("|", "id", F.lit(kind), "content_hash").alias("id"), F.col("id").alias("document_id"), "revision", "content_hash", F.lit(kind).alias("kind"), F.col(at).alias("created_at"), F.lit(0).alias("attempts"), F.lit(False).alias("dead_lettered"))


def _revision(changed: DataFrame, message: str) -> DataFrame:
    return changed.select(F.col("id").alias("doc_id"), "revision", F.lit(None).cast("string").alias("author"), F.lit(message).alias("message"), "content_hash", "content", F.col("updated_at").alias("created_at"))


def _applied(state: State, changed: DataFrame, kind: str, message: str, conflicts: DataFrame, gone: DataFrame | None = None) -> State:
    """``changed`` replaces the rows of its ids (and of ``gone``), and leaves a revision and an operation each."""
    away = changed.select("id") if gone is None else changed.select("id").unionByName(gone.select("id"))
    documents = state.documents.join(away, "id", "left_anti").select(*DOC).unionByName(changed.select(*DOC))
    outbox = state.outbox.join(_operation(changed, kind).select("id"), "id", "left_anti").select(*OPS).unionByName(_operation(changed, kind))
    return State(documents, append_history(state.revisions, _revision(changed, message)), state.edges, outbox, conflicts, Delta(changed, kind, message, gone))


def append_history(revisions: DataFrame, new: DataFrame) -> DataFrame:
    """Adds revisions that are not there yet; a repeat adds nothing."""
    fresh = new.dropDuplicates(["doc_id", "revision"]).join(revisions.select("doc_id", "revision"), ["doc_id", "revision"], "left_anti")
    return revisions.select(*REV).unionByName(fresh.select(*REV))


def upsert(state: State, changes: DataFrame, now: Column) -> State:
    """changes: id, collection, content, and optionally expected_revision and expected_hash.

    The precondition is checked first; then content of an unchanged hash is a no-op. Another collection for a
    known id, or a path that a live document holds, is a conflict."""
    have = {c: F.col(c) if c in changes.columns else F.lit(None).cast("string") for c in ("expected_revision", "expected_hash")}
    new = changes.select("id", F.col("collection").alias("_collection"), F.col("content").alias("_content"), sha256(F.col("content")).alias("_hash"), have["expected_revision"].alias("_rev"), have["expected_hash"].alias("_expected"))
    joined = new.join(state.documents.select(*DOC), "id", "left")
    reason = (
        F.when(F.col("_rev").isNotNull() & ~F.col("_rev").eqNullSafe(F.col("revision")), "revision")
        .when(F.col("_expected").isNotNull() & ~F.col("_expected").eqNullSafe(F.col("content_hash")), "content hash")
        .when(F.col("collection").isNotNull() & (F.col("collection") != F.col("_collection")), "collection")
    )
    judged = joined.withColumn("reason", reason)
    fresh = judged.where(F.col("reason").isNull() & (F.col("content_hash").isNull() | (F.col("content_hash") != F.col("_hash")) | F.col("deleted")))
    rows = fresh.select("id", F.col("_collection").alias("collection"), F.concat("id", F.lit(".md")).alias("path"), F.col("_content").alias("content"), F.col("_hash").alias("content_hash"), F.col("_hash").alias("revision"), F.when(F.col("updated_at").isNull(), now).otherwise(next_timestamp(now, F.col("updated_at"), F.col("updated_at"))).alias("updated_at"), F.lit(False).alias("deleted"))
    live = state.documents.where(~F.col("deleted")).select("path", F.col("id").alias("_holder"))
    held = rows.join(live, "path").where(F.col("_holder") != F.col("id")).select("id").distinct()
    rows = rows.join(held, "id", "left_anti")
    known = rows.join(state.revisions.select(F.col("doc_id").alias("id"), "revision"), ["id", "revision"], "left_semi")
    conflicts = judged.where("reason IS NOT NULL").select("id", "reason").unionByName(known.select("id", F.lit("revision exists").alias("reason"))).unionByName(held.select("id", F.lit("path held").alias("reason")))
    return _applied(state, rows.join(known.select("id"), "id", "left_anti"), "UPSERT", "upsert", conflicts)


def delete(state: State, ids: DataFrame, now: Column) -> State:
    """Tombstones: the content stays, and the revision says that it is deleted. Ids that are not live are conflicts."""
    rows = state.documents.where(~F.col("deleted")).join(ids.select("id"), "id", "left_semi").select(*DOC).withColumns({"revision": F.concat(F.lit("deleted-"), "revision"), "deleted": F.lit(True), "updated_at": next_timestamp(now, F.col("updated_at"), F.col("updated_at"))})
    conflicts = ids.select("id").join(state.documents.where(~F.col("deleted")).select("id"), "id", "left_anti").select("id", F.lit("not live").alias("reason"))
    return _applied(state, rows, "DELETE", "delete", conflicts)


def restore(state: State, ids: DataFrame, now: Column) -> State:
    """Back from tombstones. What is live already is left alone; a path that a live document holds is a conflict."""
    dead = state.documents.where("deleted").join(ids.select("id"), "id", "left_semi").select(*DOC)
    held = state.documents.where(~F.col("deleted")).select("collection", "path")
    rows = dead.join(held, ["collection", "path"], "left_anti").select(*DOC).withColumns({"revision": F.concat(F.lit("restored-"), "revision"), "deleted": F.lit(False), "updated_at": next_timestamp(now, F.col("updated_at"), F.col("updated_at"))})
    conflicts = dead.join(held, ["collection", "path"], "left_semi").select("id", F.lit("path held").alias("reason")).unionByName(ids.select("id").join(state.documents.select("id"), "id", "left_anti").select("id", F.lit("unknown").alias("reason")))
    return _applied(state, rows, "UPSERT", "restore", conflicts)


def rename(state: State, moves: DataFrame, now: Column) -> State:
    """moves: old_id, new_id. A live target is a conflict and a tombstone is reclaimed; both ends of edges and the history move too."""
    live = state.documents.where(~F.col("deleted"))
    taken = moves.join(live.select(F.col("id").alias("new_id")), "new_id", "left_semi").select("old_id", F.lit("target live").alias("reason"))
    absent = moves.join(live.select(F.col("id").alias("old_id")), "old_id", "left_anti").select("old_id", F.lit("not live").alias("reason"))
    conflicts = taken.unionByName(absent).select(F.col("old_id").alias("id"), "reason")
    good = moves.join(conflicts.select(F.col("id").alias("old_id")), "old_id", "left_anti").select("old_id", "new_id")
    rows = live.select(*DOC).join(good.withColumnRenamed("old_id", "id"), "id").withColumns({"id": F.col("new_id"), "path": F.concat("new_id", F.lit(".md")), "revision": F.concat(F.lit("renamed-"), "revision"), "updated_at": next_timestamp(now, F.col("updated_at"), F.col("updated_at"))}).drop("new_id")
    revisions = moved(state.revisions, good, ["doc_id"])
    edges = moved(state.edges, good, ["src", "dst"]).dropDuplicates(["src", "dst", "rel"])
    gone = _operation(live.join(good.select(F.col("old_id").alias("id")), "id", "left_semi").select(*DOC), "DELETE")
    out = _applied(replace(state, revisions=revisions), rows, "UPSERT", "rename", conflicts, good.select(F.col("old_id").alias("id")))
    return replace(out, edges=edges, outbox=out.outbox.unionByName(gone.join(out.outbox.select("id"), "id", "left_anti")), delta=replace(out.delta, moves=good))


def moved(rows: DataFrame, moves: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ids in ``columns`` mapped by moves (old_id, new_id)."""
    out = rows
    for c in columns:
        out = out.join(moves.select(F.col("old_id").alias(c), F.col("new_id").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.select(*rows.columns)


def relink(state: State, moves: DataFrame, now: Column) -> State:
    """Rewrites the links of whoever refers to a moved document (old_id, new_id) to its new id, with a revision of its own."""
    forms = moves.select(F.col("old_id").alias("dst"), "new_id", suffixes(F.col("old_id")).alias("forms"))
    referrers = state.edges.select("src", "dst").distinct().join(forms, "dst").select(F.col("src").alias("id"), "forms", "new_id")
    rows = state.documents.where(~F.col("deleted")).select(*DOC).join(referrers, "id").withColumn("content", retargeted(F.col("content"), F.col("forms"), F.col("new_id"))).drop("forms", "new_id")
    rows = rows.withColumns({"content_hash": sha256(F.col("content")), "revision": F.concat(F.lit("relinked-"), "revision"), "updated_at": next_timestamp(now, F.col("updated_at"), F.col("updated_at"))})
    return _applied(state, rows, "UPSERT", "relink", rows.select("id", F.lit("").alias("reason")).limit(0))


def deduplicated_requests(requests: DataFrame, ttl_hours: int = 24, capacity: int | None = None, ties: Sequence[str] = ("payload_hash",)) -> DataFrame:
    """requests (key, payload_hash, at, completed) with their outcome: reserve, replay, conflict or in-flight.

    A reservation holds its key until it is older than its time to live; the next request then reserves anew. A store
    that holds ``capacity`` keys drops its oldest completed one for a new key, and refuses (conflict) where all are in
    flight. Requests of one time come in the order of ``ties`` and key. With a capacity each outcome depends on all before
    it, whatever the key, so one task reads all requests in order; it holds ``capacity`` keys, 1,000 in a small store. Without one, which is
    for tables of any size, keys are dealt over tasks, each of which reads its keys one after the other."""
    schema = T.StructType([*requests.schema, T.StructField("outcome", T.StringType())])
    ttl = ttl_hours * 3_600_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, OrderedDict] = {True: OrderedDict(), False: OrderedDict()}  # by completed; oldest first

        def outcome(key, payload, at: int, completed: bool) -> str:
            for entries in held.values():
                while entries and at - next(iter(entries.values()))[1] > ttl:
                    entries.popitem(last=False)
            for done, entries in held.items():
                if key in entries:
                    return "conflict" if entries[key][0] != payload else "replay" if done else "in-flight"
            if capacity is not None and sum(map(len, held.values())) >= capacity:
                if not held[True]:
                    return "conflict"
                held[True].popitem(last=False)
            held[completed][key] = payload, at
            return "reserve"

        last = None
        for batch in batches:
            keys, payloads, completed = (batch.column(c).to_pylist() for c in ("key", "payload_hash", "completed"))
            times = batch.column("at").cast(pa.int64()).to_pylist()
            made = []
            for k, p, t, c in zip(keys, payloads, times, completed, strict=True):
                if capacity is None and k != last:
                    held[True].clear()
                    held[False].clear()
                    last = k
                made.append(outcome(k, p, t, bool(c)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], schema.fieldNames())

    if capacity is None:
        n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return requests.repartition(n, "key").sortWithinPartitions("key", "at", *ties).mapInArrow(run, schema)
    return requests.repartition(1).sortWithinPartitions("at", *ties, "key").mapInArrow(run, schema)
