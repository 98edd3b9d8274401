"""A drain that applies: operations of an outbox change the index, the edges and the references of their documents, exactly once.

A batch of the stream, and the operations that earlier batches put off and that are due, make one change of a ``Projection``:
segments of the index, of the edges, of the references and of what waits, and the batch's number in the ledger. All count
with one manifest, so a batch that failed half way has done nothing, and one that is run again finds its number and does nothing.

An operation applies only if the store still agrees with it. What cannot be read fails: it counts an attempt and waits until
``not_before``, or is given up. References (suffix form of a link, its source) are kept partitioned by a hash of the
form, so that when documents come or go the notes whose links may resolve otherwise are found by reading the partitions of
their forms, and only those notes are derived anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.markdown import PARSED, parsed
from ..functions.text import link_form, suffixes
from ..operators import index as indexes
from ..operators.changes import fresh_operations, settled, snapshot_diff
from ..operators.graph import DRAWN, derived
from ..operators.index import StoredIndex
from ..operators.segments import Change, Manifest, Spec, Tables, among, part_of, parts_for
from ..shared import written

SPECS = indexes.SPECS | {"edges": Spec("src"), "references": Spec("src", "part"), "waiting": Spec("id"), "tokens": Spec("id")}
WAITING = ["id", "document_id", "content_hash", "kind", "created_at", "attempts", "dead_lettered", "not_before"]


def notes(documents: DataFrame, fields: Sequence[str] = tuple(PARSED)) -> DataFrame:
    """Documents (id, collection, content) parsed: ``fields``, among them the index's, links, refs and author."""
    return documents.select("id", "collection", "content", parsed(F.col("content"), fields).alias("p")).select("id", "collection", "content", "p.*")


class Projection:
    """``prepare`` makes of documents what is indexed and, as ``notes`` does, links, refs and author. ``readable`` says which documents can be prepared."""

    def __init__(self, spark: SparkSession, folder: str, fields: Sequence[str] = ("title", "content"), content: str = "content", prepare: Callable[[DataFrame], DataFrame] = notes, readable: str = "content IS NOT NULL"):
        self.spark, self.prepare, self.readable = spark, prepare, readable
        self.tables = Tables(spark, folder, SPECS)
        self.index = StoredIndex(spark, folder, fields, content, tables=self.tables)
        self.drawn = prepare  #: what edges are derived from
        if prepare is notes:  # only what is stored
            indexed = [f for f in PARSED if f in {*fields, content, *indexes.ATTRIBUTES, *DRAWN}]
            self.prepare, self.drawn = partial(notes, fields=indexed), partial(notes, fields=DRAWN)

    # reading

    def edges(self) -> DataFrame | None:
        return self.tables.read(self.tables.manifest(), "edges")

    def waiting(self) -> DataFrame | None:
        """Operations that failed, those given up among them."""
        return self.tables.read(self.tables.manifest(), "waiting")

    def done(self, stream: str) -> int:
        """The last batch of ``stream`` that counts; -1 before the first."""
        return self.tables.manifest().info.get(f"ledger/{stream}", -1)

    def referrers(self, base: Manifest, changed: DataFrame) -> DataFrame | None:
        """id of the notes of which a link may resolve otherwise since ``changed`` (id) came or went; of each segment the partitions of their suffixes are read."""
        forms = written(changed.select(F.explode(suffixes(F.col("id"))).alias("form")).distinct())
        found = self.tables.read(base, "references", lambda rows, s: among(rows, forms, "form", "part", s))
        return None if found is None else found.select(F.col("src").alias("id")).distinct()

    # applying

    def apply(self, operations: DataFrame, documents: DataFrame, stream: str, batch: int, now: datetime) -> bool:
        """Whether the batch changed anything: not if the ledger has it. operations: id, document_id, content_hash, kind, created_at, attempts, dead_lettered; documents: the store's."""
        if batch <= self.done(stream):
            return False
        base = self.tables.manifest()
        rows = operations.select(*WAITING[:-1]).withColumn("not_before", F.lit(None).cast("timestamp"))
        held = self.tables.read(base, "waiting")
        if held is not None:
            due = held.where(~F.col("dead_lettered") & (F.coalesce(F.col("not_before"), F.lit(now)) <= F.lit(now)))
            rows = due.unionByName(rows.join(held.select("id"), "id", "left_anti"))
        judged = written(fresh_operations(rows.where(~F.col("dead_lettered")), documents))
        work = judged.where("apply").groupBy(F.col("document_id").alias("id")).agg(F.max_by("kind", F.struct("created_at", "id")).alias("kind"))
        live = documents.where(~F.col("deleted"))
        ups = written(live.join(work.where("kind = 'UPSERT'").select("id"), "id", "left_semi").withColumn("_ok", F.coalesce(F.expr(self.readable), F.lit(False))))
        gone = written(work.where("kind = 'DELETE'").select("id"))
        staged, change = self._changed(base, ups.where("_ok").drop("_ok"), gone, live)
        bad = ups.where("NOT _ok").select(F.col("id").alias("document_id"), F.lit(False).alias("_bad"))
        results = judged.join(bad, "document_id", "left").select("id", (F.col("_bad").isNull() | ~F.col("apply")).alias("ok"))
        rest = settled(judged.drop("apply", "not_before"), results, F.lit(now))
        change += self.tables.stage("waiting", rest.select(*WAITING), judged.select("id"))

        def made(newest: Manifest) -> Change:
            if newest.info.get(f"ledger/{stream}", -1) >= batch:
                raise AlreadyApplied
            return self.index.change(newest, staged) + change + Change(info={f"ledger/{stream}": batch})

        try:
            self.tables.apply(made)
        except AlreadyApplied:  # by another run of the batch
            return False
        return True

    def _changed(self, base: Manifest, ups: DataFrame, gone: DataFrame, live: DataFrame) -> tuple:
        """What the index stages, and the segments of the edges and references."""
        good = written(self.prepare(ups))
        return self.index.staged(good, gone), self._linked(base, good, gone, good.select("id").unionByName(gone), live)

    def reconcile(self, snapshot: DataFrame, documents: DataFrame, drain: Callable[[], bool] | None = None) -> DataFrame:
        """Brings the projection to what a scan found: snapshot (id, change_token). Returns change (added, updated, removed, failed, unchanged) and n.

        The tokens of the last pass are stored, and only documents whose token differs are read and derived; a pass without
        differences writes nothing. What cannot be read keeps its old token, so that the next pass tries it again. ``drain``
        comes first; if it says that it failed, the pass stops before it changes anything."""
        if drain is not None and not drain():
            raise DrainFailed
        base = self.tables.manifest()
        known = self.tables.read(base, "tokens")
        if known is None:
            known = snapshot.select("id", "change_token").limit(0)
        diff = written(snapshot_diff(known, snapshot))
        changed = diff.where("change <> 'unchanged'")
        if changed.isEmpty():
            return diff.groupBy("change").agg(F.count("*").alias("n"))
        live = documents.where(~F.col("deleted"))
        gone = changed.where("change = 'removed'").select("id")
        ups = written(live.join(changed.where("change <> 'removed'").select("id"), "id", "left_semi").withColumn("_ok", F.coalesce(F.expr(self.readable), F.lit(False))))
        read = ups.where("_ok").select("id")
        staged, change = self._changed(base, ups.where("_ok").drop("_ok"), gone, live)
        change += self.tables.stage("tokens", snapshot.select("id", "change_token").join(read, "id", "left_semi"), read.unionByName(gone))
        self.tables.apply(lambda newest: self.index.change(newest, staged) + change)
        told = diff.join(read.withColumn("_r", F.lit(True)), "id", "left").select(F.when(F.col("change").isin("added", "updated") & F.col("_r").isNull(), "failed").otherwise(F.col("change")).alias("change"))
        return told.groupBy("change").agg(F.count("*").alias("n"))

    def _linked(self, base: Manifest, good: DataFrame, gone: DataFrame, moved: DataFrame, live: DataFrame) -> Change:
        """Edges of what changed and of the notes that point to what came or went; references of what changed."""
        known = self.tables.read(base, "documents", lambda rows, s: among(rows.select("id", "part"), good, "id", "part", s))
        came = good.select("id") if known is None else good.select("id").join(known, "id", "left_anti")
        sources = self.referrers(base, came.unionByName(gone))
        drawn, away = good, moved
        if sources is not None:
            others = written(sources.join(moved, "id", "left_anti"))
            again = self.drawn(live.join(others, "id", "left_semi").where(self.readable))
            drawn, away = good.select("id", *DRAWN).unionByName(again.select("id", *DRAWN)), moved.unionByName(others)
        change = self.tables.stage("edges", derived(drawn, live), away.select(F.col("id").alias("src")))
        links = good.select(F.col("id").alias("src"), F.inline("links")).select("src", link_form(F.col("target")).alias("form")).distinct()
        parts = parts_for(links.count())
        return change + self.tables.stage("references", links.withColumn("part", part_of(F.col("form"), parts)), moved.select(F.col("id").alias("src")), parts)

    def compact(self) -> None:
        self.index.compact()
        self.tables.compact("edges")
        self.tables.compact("references", lambda rows, n: rows.withColumn("part", part_of(F.col("form"), n)))
        self.tables.compact("waiting")
        self.tables.compact("tokens")


class AlreadyApplied(Exception):
    pass


class DrainFailed(RuntimeError):
    """What waits could not be drained, so nothing was reconciled."""


def applied(stream: DataFrame, projection: Projection, documents: Callable[[], DataFrame], checkpoint: str, now: Callable[[], datetime], name: str = "outbox") -> StreamingQuery:
    """Applies ``stream`` (operations) to ``projection`` over what is there now; ``documents`` reads the store as it is at each batch."""

    def write(rows: DataFrame, batch: int) -> None:
        projection.apply(rows, documents(), name, batch, now())

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
