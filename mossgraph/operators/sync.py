"""Replicas and transfer: conflict resolution, two-way convergence, import plans and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitized
from .graph import unresolved
from .store import moved

SIDE = ["collection", "path", "content_hash", "deleted", "updated_at"]
Resolver = Callable[[], Column]


def local_wins() -> Column:
    """A missing side loses; a tombstone beats a live document; then the later change, and of equal ones the greater hash."""
    local, remote = (F.struct(F.col(f"{s}_deleted"), F.col(f"{s}_updated_at"), F.col(f"{s}_content_hash")) for s in ("l", "r"))
    return F.when(F.col("r_content_hash").isNull(), True).when(F.col("l_content_hash").isNull(), False).otherwise(local >= remote)


def compared(local: DataFrame, remote: DataFrame, resolver: Resolver = local_wins) -> DataFrame:
    """Both sides of every id, whether they agree (revisions aside), whether both have it and differ, and the winner."""
    side = lambda d, s: d.select("id", *(F.col(c).alias(f"{s}_{c}") for c in SIDE))
    both = side(local, "l").join(side(remote, "r"), "id", "full_outer")
    same = F.col("l_content_hash").eqNullSafe(F.col("r_content_hash")) & F.col("l_deleted").eqNullSafe(F.col("r_deleted")) & F.col("l_path").eqNullSafe(F.col("r_path")) & F.col("l_collection").eqNullSafe(F.col("r_collection"))
    there = F.col("l_content_hash").isNotNull() & F.col("r_content_hash").isNotNull()
    return both.withColumns({"same": same, "conflict": there & ~same, "winner": F.when(same, "both").when(resolver(), "local").otherwise("remote")})


def converged(local: DataFrame, remote: DataFrame, resolver: Resolver = local_wins) -> DataFrame:
    """The state that both replicas have after a sync."""
    rows = compared(local, remote, resolver)
    return rows.select("id", *(F.when(F.col("winner") == "remote", F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(c) for c in SIDE))


def pushed(local: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to send, and what comes back as the echo of remote winners."""
    rows = compared(local, remote)
    return rows.where("winner = 'local'").select("id"), rows.where("winner = 'remote'").select("id")


def report(rows: DataFrame) -> DataFrame:
    """How many ids were pushed, pulled or unchanged, and how many of them were conflicts."""
    outcome = F.when(F.col("winner") == "local", "pushed").when(F.col("winner") == "remote", "pulled").otherwise("unchanged")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("documents"), F.count_if("conflict").alias("conflicts"))


def stale(incoming: DataFrame, local: DataFrame) -> DataFrame:
    """``incoming`` with ``stale``: the same id is here with another hash and a later change."""
    here = local.select("id", F.col("content_hash").alias("_h"), F.col("updated_at").alias("_u"))
    return incoming.join(here, "id", "left").withColumn("stale", F.coalesce((F.col("_h") != F.col("content_hash")) & (F.col("_u") > F.col("updated_at")), F.lit(False))).drop("_h", "_u")


def transferred(documents: DataFrame, edges: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and edges for another store, and failures as rows. Edges into tombstones go, last of all."""
    judged = stale(documents, target)
    failures = judged.where("stale").select("id", F.lit("stale").alias("reason"))
    moved_on = judged.where(~F.col("stale")).drop("stale")
    dead = moved_on.where("deleted").select(F.col("id").alias("dst"))
    return moved_on, edges.join(moved_on.select(F.col("id").alias("src")), "src", "left_semi").join(dead, "dst", "left_anti").select(*edges.columns), failures


def rederived(documents: DataFrame, edges: DataFrame, id_of: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Documents under ids made from their paths, and edges under the same mapping."""
    mapping = documents.select(F.col("id").alias("old_id"), id_of(F.col("path")).alias("new_id"))
    return documents.withColumn("id", id_of(F.col("path"))), moved(edges, mapping, ["src", "dst"])


def import_plan(sources: DataFrame) -> DataFrame:
    """sources (path) with the id each becomes and what happens: import, rename (its name was changed) or collision (an earlier source has the id)."""
    rows = sources.withColumn("id", sanitized(F.col("path")))
    first = rows.groupBy("id").agg(F.min("path").alias("_first"))
    action = F.when(F.col("id") == "", "reject").when(F.col("path") != F.col("_first"), "collision").when(F.concat("id", F.lit(".md")) != F.col("path"), "rename").otherwise("import")
    return rows.join(first, "id").withColumn("action", action).drop("_first")


def import_report(parsed: DataFrame, plan: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that resolve to nothing after the import, and links that a changed name makes invalid."""
    after = documents.select("id").unionByName(plan.where("action IN ('import', 'rename')").select("id")).distinct()
    renamed = plan.where("action = 'rename'").select(F.regexp_replace("path", r"(?i)\.md$", "").alias("target"))
    return unresolved(parsed, after), parsed.select(F.col("id").alias("src"), F.inline("links")).join(renamed, "target", "left_semi").select("src", "target")
