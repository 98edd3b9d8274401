"""A stored state: documents, history, edges and outbox that change in one transaction.

``commit`` takes one of the changes of ``store`` (upsert, delete, restore, rename, relink), makes it of the newest version and
writes what it changes as segments, which count together once the manifest is committed. If another writer has
committed meanwhile, the change is made anew of that version, so preconditions hold against what is really there
and the loser's rows become conflicts. Whatever fails before the manifest leaves the old version.

A change reads narrow columns of the state to check its rows, and writes only what it changes; a rename rewrites the history
of the documents that move, and the edges of the sources that they touch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGES
from ..shared import written
from .changes import settled
from .graph import EDGE_KEY
from .segments import Change, Manifest, Spec, Tables, part_of, parts_for
from .store import DOC, OPS, REV, Delta, State, _operation, _revision, moved

SPECS = {"documents": Spec("id", "part"), "revisions": Spec("doc_id"), "edges": Spec("src"), "outbox": Spec("id")}
EMPTY = {
    "documents": "id string, collection string, path string, content string, content_hash string, revision string, updated_at timestamp, deleted boolean, part int",
    "revisions": "doc_id string, revision string, author string, message string, content_hash string, content string, created_at timestamp",
    "edges": EDGES,
    "outbox": "id string, document_id string, revision string, content_hash string, kind string, created_at timestamp, attempts int, dead_lettered boolean",
}


@dataclass(frozen=True)
class Committed:
    version: int
    conflicts: DataFrame  #: id, reason; written


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.tables = spark, Tables(spark, folder, SPECS)

    def _read(self, base: Manifest, table: str, each=None) -> DataFrame:
        found = self.tables.read(base, table, each)
        return (self.spark.createDataFrame([], EMPTY[table]) if found is None else found).drop("part")

    def state(self, version: int | None = None) -> State:
        base = self.tables.manifest(version)
        return State(*(self._read(base, t) for t in ("documents", "revisions", "edges", "outbox")))

    def read(self, id: object, with_deleted: bool = False) -> DataFrame:
        """One document; a part of each segment is read."""
        base = self.tables.manifest()
        rows = self._read(base, "documents", lambda rows, s: rows.where((F.col("part") == part_of(F.lit(id), s.parts)) & (F.col("id") == F.lit(id))))
        return rows if with_deleted else rows.where(~F.col("deleted"))

    def _documents(self, rows: DataFrame, gone: DataFrame) -> Change:
        parts = parts_for(rows.count())
        return self.tables.stage("documents", rows.select(*DOC, part_of(F.col("id"), parts).alias("part")), gone, parts)

    def load(self, state: State) -> int:
        """Adds a whole state, such as an import; its documents take the place of their ids' rows."""
        change = self._documents(state.documents, state.documents.select("id"))
        change += self.tables.stage("revisions", state.revisions.select(*REV), state.revisions.select("doc_id"))
        change += self.tables.stage("edges", state.edges, state.edges.select("src"))
        change += self.tables.stage("outbox", state.outbox.select(*OPS), state.outbox.select("id"))
        return self.tables.apply(lambda base: change).version

    def commit(self, change: Callable[[State], State]) -> Committed:
        conflicts: list[DataFrame] = []

        def made(base: Manifest) -> Change:
            before = State(*(self._read(base, t) for t in ("documents", "revisions", "edges", "outbox")))
            after = change(before)
            conflicts[:] = [written(after.conflicts)]
            return self._staged(before, after.delta)

        return Committed(self.tables.apply(made).version, conflicts[0])

    def _staged(self, before: State, delta: Delta) -> Change:
        changed = written(delta.changed.select(*DOC))  # from here on the other tables follow from what is written
        away = changed.select("id") if delta.gone is None else changed.select("id").unionByName(delta.gone.select("id"))
        out = self._documents(changed, away)
        ops = _operation(changed, delta.kind)
        revisions = _revision(changed, delta.message)
        if delta.moves is not None:
            moves = written(delta.moves)
            old = moves.select(F.col("old_id").alias("doc_id"))
            history = moved(before.revisions.join(old, "doc_id", "left_semi"), moves, ["doc_id"])
            out += self.tables.stage("revisions", history.unionByName(revisions).select(*REV), old)
            ends = moves.select(F.col("old_id").alias("id"))
            touched = before.edges.join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src").unionByName(ends.select(F.col("id").alias("src"))).distinct()
            edges = moved(before.edges.join(touched, "src", "left_semi"), moves, ["src", "dst"]).dropDuplicates(EDGE_KEY)
            out += self.tables.stage("edges", edges, touched)
            gone = before.documents.join(ends, "id", "left_semi").select(*DOC)
            ops = ops.unionByName(_operation(gone, "DELETE"))
        else:
            known = before.revisions.join(changed.select(F.col("id").alias("doc_id"), "revision"), ["doc_id", "revision"], "left_semi").select("doc_id", "revision")
            out += self.tables.stage("revisions", revisions.join(known, ["doc_id", "revision"], "left_anti").select(*REV))
        return out + self.tables.stage("outbox", ops.select(*OPS), ops.select("id"))

    def replace_edges(self, new: DataFrame, sources: DataFrame) -> int:
        """The out-edges of ``sources`` (id) are ``new``, whose first of a key counts; one transaction."""
        change = self.tables.stage("edges", new.dropDuplicates(EDGE_KEY), sources.select(F.col("id").alias("src")))
        return self.tables.apply(lambda base: change).version

    def settle(self, results: DataFrame, now) -> int:
        """The outbox after a drain: results (id, ok)."""

        def made(base: Manifest) -> Change:
            rows = settled(self._read(base, "outbox").join(results.select("id"), "id", "left_semi"), results, now)
            return self.tables.stage("outbox", rows.select(*OPS), results.select("id"))

        return self.tables.apply(made).version

    def compact(self) -> None:
        for table in SPECS:
            self.tables.compact(table, lambda rows, n: rows.withColumn("part", part_of(F.col("id"), n)))
