"""Transfer between stores: what differs is found by a tree of digests, and moves in bounded batches, each a transaction.

Ids fall into 2 ** (4 * DEPTH) ranges of their hash. A range's digest is the number of its documents and two sums of hashes of
their states; that of a node above is the sum of its children's, so levels come from one aggregation of narrow columns.
Two trees are compared from the top, and below a node that agrees nothing is looked at. Only documents of the ranges that differ
are compared, and only those that the target lacks or that win against its own are moved, with their whole history and their edges.

A document that cannot be moved is a row of failures and keeps none of the others back: one that cannot be read, one whose path another
live document of the target holds, and one that the target has changed later. Edges into tombstones go last.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .graph import EDGE_KEY
from .segments import Change
from .store import DOC, REV, State
from .stored import Store
from .sync import SIDE, compared

DEPTH, FAN_BITS = 4, 4
DIGEST = ["n", "a", "b"]


def range_of(id: Column, level: int = DEPTH) -> Column:
    """The range of an id at a level, 0 the whole."""
    return F.shiftrightunsigned(F.xxhash64(id), 64 - FAN_BITS * level).cast("int") if level else F.lit(0)


def digests(documents: DataFrame, level: int = DEPTH) -> DataFrame:
    """range, n, a and b; two states give one digest only if they agree, or if 128 bits of hashes do."""
    state = F.struct("id", *SIDE)
    low = lambda seed: F.xxhash64(state, F.lit(seed)).cast("decimal(38,0)")
    return documents.groupBy(range_of(F.col("id"), level).alias("range")).agg(F.count("*").alias("n"), F.sum(low(1)).alias("a"), F.sum(low(2)).alias("b"))


def above(leaves: DataFrame, levels: int) -> DataFrame:
    """The digests so many levels further up."""
    return leaves.groupBy(F.shiftright("range", FAN_BITS * levels).alias("range")).agg(*(F.sum(c).alias(c) for c in DIGEST))


def differing(local: DataFrame, remote: DataFrame, depth: int = DEPTH) -> DataFrame:
    """range: those of the leaves that differ; local and remote are digests of leaves."""
    found = None
    for level in range(depth + 1):
        mine, theirs = (above(side, depth - level) for side in (local, remote))
        if found is not None:  # the children of what differs above
            mine, theirs = (side.join(found.select(F.col("range").alias("_up")), F.shiftright("range", FAN_BITS) == F.col("_up"), "left_semi") for side in (mine, theirs))
        other = theirs.select(F.col("range").alias("_r"), *(F.col(c).alias(f"_{c}") for c in DIGEST))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DIGEST))
        found = mine.join(other, F.col("range") == F.col("_r"), "full_outer").where(~same).select(F.coalesce("range", "_r").alias("range"))
    return found


@dataclass(frozen=True)
class Transfer:
    batches: int
    moved: DataFrame  #: id, batch
    failures: DataFrame  #: id, stage, reason


def compare(source: DataFrame, target: DataFrame) -> DataFrame:
    """What ``sync.compared`` says of the documents in ranges that differ; the target is local. At most 2 ** (4 * DEPTH) ranges."""
    ranges = written(differing(digests(target), digests(source)))
    side = lambda d: d.withColumn("range", range_of(F.col("id"))).join(F.broadcast(ranges), "range", "left_semi").select("id", *SIDE)
    return compared(side(target), side(source)).where("NOT same")


def transfer(source: State, target: Store, size: int = 1000) -> Transfer:
    """Moves into ``target`` what of ``source`` it lacks or what wins, about ``size`` documents a batch. A batch that was committed is not moved again by the next run."""
    here = target.state()
    judged = written(compare(source.documents, here.documents).select("id", "winner", "conflict"))
    coming = source.documents.join(judged.where("winner = 'remote'").select("id"), "id", "left_semi")
    held = here.documents.where(~F.col("deleted")).select("path", F.col("id").alias("_holder"))
    taken = coming.where(~F.col("deleted")).join(held, "path").where(F.col("_holder") != F.col("id")).select("id", F.lit(True).alias("_taken")).distinct()
    reason = F.when(F.col("content").isNull(), F.struct(F.lit("read").alias("stage"), F.lit("unreadable").alias("reason"))).when(F.col("_taken"), F.struct(F.lit("documents").alias("stage"), F.lit("path held").alias("reason")))
    checked = coming.join(taken, "id", "left").withColumn("_why", reason)
    stale = judged.where("winner = 'local' AND conflict").select("id", F.lit("documents").alias("stage"), F.lit("stale").alias("reason"))
    failures = written(checked.where("_why IS NOT NULL").select("id", "_why.*").unionByName(stale))
    good = checked.where("_why IS NULL").select("id", "deleted")
    batches = -(-good.count() // size)
    moved = written(good.withColumn("batch", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, batches))).cast("int")))
    for k in range(batches):
        ids = moved.where(F.col("batch") == k).select("id")
        rows = written(source.documents.join(ids, "id", "left_semi").select(*DOC))
        known = here.revisions.select("doc_id", "revision")
        history = source.revisions.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").join(known, ["doc_id", "revision"], "left_anti").select(*REV).dropDuplicates(["doc_id", "revision"])
        edges = source.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").dropDuplicates(EDGE_KEY)
        change: Change = target._documents(rows, ids) + target.tables.stage("revisions", history) + target.tables.stage("edges", edges, ids.withColumnRenamed("id", "src"))
        target.tables.apply(lambda base, change=change: change)
    dead = moved.where("deleted").select(F.col("id").alias("dst"))
    now = target.state().edges
    touched = written(now.join(dead, "dst", "left_semi").select("src").distinct())
    if not touched.isEmpty():
        rest = now.join(touched, "src", "left_semi").join(dead, "dst", "left_anti").select(*now.columns)
        change = target.tables.stage("edges", rest, touched)
        target.tables.apply(lambda base: change)
    return Transfer(batches, moved.select("id", "batch"), failures)
