"""The outbox, reconciliation, rebuilds, the change feed and the overlay of pending writes, as batch computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS, MAX_BACKOFF_S, LEASE_S = 5, 60, 30
RETAINED, OVERLAY_ENTRIES, OVERLAY_TTL_S = 512, 1000, 300


def live_operations(outbox: DataFrame, limit: int | None = None) -> DataFrame:
    """What waits, oldest first; dead letters are out before the limit counts."""
    rows = outbox.where(~F.col("dead_lettered")).orderBy("created_at", "id")
    return rows if limit is None else rows.limit(limit)


def fresh_operations(outbox: DataFrame, documents: DataFrame) -> DataFrame:
    """``outbox`` with ``apply``: an upsert only if the store still has its hash, a delete only if the document is still gone."""
    here = documents.where(~F.col("deleted")).select(F.col("id").alias("document_id"), F.col("content_hash").alias("_h"))
    same = F.when(F.col("kind") == "UPSERT", F.col("_h").eqNullSafe(F.col("content_hash"))).otherwise(F.col("_h").isNull())
    return outbox.join(here, "document_id", "left").withColumn("apply", same).drop("_h")


def backoff_s(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2), attempts - 1), F.lit(MAX_BACKOFF_S)).cast("long")


def settled(outbox: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The outbox after a drain: results (id, ok). Done rows go; failed ones count an attempt and wait, or are given up."""
    rows = outbox.join(results.select("id", "ok"), "id", "left")
    tries = F.when(F.col("ok").eqNullSafe(F.lit(False)), F.col("attempts") + 1).otherwise(F.col("attempts"))
    rest = rows.where(~F.col("ok").eqNullSafe(F.lit(True))).withColumn("attempts", tries)
    failed = F.col("ok").eqNullSafe(F.lit(False))
    return rest.withColumns({"dead_lettered": F.col("dead_lettered") | (failed & (F.col("attempts") >= MAX_ATTEMPTS)), "not_before": F.when(failed, F.timestamp_seconds(F.unix_timestamp(now) + backoff_s(F.col("attempts"))))}).drop("ok")


def claimed(outbox: DataFrame, owner: str, token: Column, now: Column, limit: int) -> DataFrame:
    """``outbox`` after ``owner`` takes the oldest operations whose lease is free, expired or its own; the token tells a later taker from it."""
    free = F.col("lease_owner").isNull() | (F.col("lease_expires_at") <= now) | (F.col("lease_owner") == owner)
    taken = outbox.where(free & ~F.col("dead_lettered")).orderBy("created_at", "id").limit(limit).select("id", F.lit(True).alias("_take"))
    take = F.col("_take").isNotNull()
    rows = outbox.join(F.broadcast(taken), "id", "left")  # ``limit`` rows
    return rows.select(*(F.when(take, new).otherwise(F.col(c)).alias(c) if (new := {"lease_owner": F.lit(owner), "lease_token": token, "lease_expires_at": now + F.make_interval(secs=F.lit(LEASE_S))}.get(c)) is not None else F.col(c) for c in outbox.columns))


def snapshot_diff(before: DataFrame, after: DataFrame, id: str = "id", token: str = "change_token") -> DataFrame:
    """id and change (added, updated, unchanged, removed) between two scans."""
    b, a = before.select(id, F.col(token).alias("_b"), F.lit(True).alias("_inb")), after.select(id, F.col(token).alias("_a"), F.lit(True).alias("_ina"))
    change = F.when(F.col("_inb").isNull(), "added").when(F.col("_ina").isNull(), "removed").when(F.col("_b").eqNullSafe(F.col("_a")), "unchanged").otherwise("updated")
    return b.join(a, id, "full_outer").select(id, change.alias("change"))


def stale_index(index: DataFrame, documents: DataFrame) -> DataFrame:
    """id of what is indexed and no longer in the store."""
    return index.select("id").distinct().join(documents.where(~F.col("deleted")).select("id"), "id", "left_anti")


def sequenced(changes: DataFrame, order: list[str], start: int = 0, bucket: Column | None = None) -> DataFrame:
    """``changes`` numbered in order without gaps.

    Rows are numbered within buckets of the first order column (hours unless given otherwise; they must not
    fall as it rises), side by side; a row per bucket tells how many come before."""
    rows = changes.withColumn("_p", F.date_trunc("hour", F.col(order[0]).cast("timestamp")) if bucket is None else bucket)
    before = F.coalesce(F.sum("_c").over(Window.orderBy(F.asc_nulls_first("_p")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy("_p").agg(F.count("*").alias("_c")).select(F.col("_p").alias("_q"), before.alias("_o"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn("_w", within).join(offsets, F.col("_p").eqNullSafe(F.col("_q"))).withColumn("sequence", F.col("_w") + F.col("_o") + start).drop("_p", "_q", "_w", "_o")


def feed(changes: DataFrame, after: int, collections: list[str] | None = None, retained: int = RETAINED) -> DataFrame:
    """What follows ``after``: the retained events, or one RESYNC if some of them have aged out."""
    ends = changes.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("_last"))
    rows = changes.where(F.col("sequence") > after)
    if collections is not None:
        rows = rows.where(F.col("collection").isin(*collections))
    marked = rows.select("sequence", "document_id", "kind").join(F.broadcast(ends)).where(F.col("_last") - retained <= after).drop("_last")
    resync = ends.where(F.col("_last") - retained > after).select(F.col("_last").alias("sequence"), F.lit(None).cast(changes.schema["document_id"].dataType).alias("document_id"), F.lit("RESYNC").alias("kind"))
    return marked.unionByName(resync)


def coalesced(events: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """The last event of each path."""
    return events.groupBy(key).agg(F.max_by("kind", order).alias("kind"), F.max(order).alias(order))


def overlay(writes: DataFrame, now: Column, entries: int = OVERLAY_ENTRIES, ttl_s: int = OVERLAY_TTL_S) -> DataFrame:
    """Pending writes (id, sequence, at, projected) that reads still have to see: the last of each id that is not projected up to the low-water mark, young enough, the newest so many."""
    gap = writes.where(~F.col("projected")).agg(F.min("sequence").alias("_mark"))
    open_ = writes.join(F.broadcast(gap)).where(F.col("_mark").isNotNull() & (F.col("sequence") >= F.col("_mark"))).drop("_mark")
    last = open_.groupBy("id").agg(*(F.max_by(c, "sequence").alias(c) for c in writes.columns if c not in ("id", "sequence")), F.max("sequence").alias("sequence"))
    return last.where(F.col("at") > now - F.make_interval(secs=F.lit(ttl_s))).orderBy(F.desc("sequence")).limit(entries)


def overlaid(base: DataFrame, pending: DataFrame, id: str = "id") -> DataFrame:
    """``base`` with pending rows in place of its own; pending deletions hide theirs."""
    rest = base.join(pending.select(id), id, "left_anti").select(*base.columns)
    return rest.unionByName(pending.where(~F.col("deleted")).select(*base.columns))


def undecodable(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Outbox records that can be read, and those that cannot, which are set aside."""
    read = lines.withColumn("_r", F.from_json(column, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = F.col("_r").isNotNull() & F.col("_r._bad").isNull()
    return read.where(good).select("_r.*").drop("_bad"), read.where(~good).select(column)


def to_embed(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """The chunks whose content has no vector of the model yet, each content once."""
    return chunks.join(vectors.where(F.col("model") == model).select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash", "chunk"])


def vanished(snapshot: DataFrame, events: DataFrame, documents: DataFrame) -> DataFrame:
    """id of the live documents to delete: those that an event (id) is about and whose file the snapshot (id) lacks."""
    gone = events.select("id").distinct().join(snapshot.select("id"), "id", "left_anti")
    return documents.where(~F.col("deleted")).select("id").join(gone, "id", "left_semi")
