"""Counts and states of a corpus and its queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .listing import under


def document_counts(docs: DataFrame, by: str = "collection") -> DataFrame:
    return docs.groupBy(by).agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("tombstones"))


def count_under(docs: DataFrame, prefix: str) -> DataFrame:
    return docs.where(~F.col("deleted") & under(F.col("path"), prefix)).agg(F.count("*").alias("n"))


def history_counts(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("doc_id").agg(F.count("*").alias("revisions"))


def backlog(outbox: DataFrame, corrupt: DataFrame | None = None) -> DataFrame:
    """One row: what waits, what failed before, their oldest, what was given up, and what could not be read."""
    waits = ~F.col("dead_lettered")
    stuck = waits & (F.col("attempts") > 0)
    out = outbox.agg(F.count_if(waits).alias("pending"), F.count_if(stuck).alias("stuck"), F.min(F.when(waits, F.col("created_at"))).alias("oldest"), F.min(F.when(stuck, F.col("created_at"))).alias("oldest_stuck"), F.count_if("dead_lettered").alias("dead"))
    return out.join(F.broadcast(corrupt.agg(F.count("*").alias("corrupt")))) if corrupt is not None else out.withColumn("corrupt", F.lit(0).cast("long"))


def collection_counts(docs: DataFrame, edges: DataFrame, id: str = "id") -> DataFrame:
    """Documents and out-edges of each collection; edges are counted by source before the join."""
    out = edges.groupBy(F.col("src").alias(id)).agg(F.count("*").alias("_e"))
    return docs.join(out, id, "left").groupBy("collection").agg(F.count("*").alias("documents"), F.coalesce(F.sum("_e"), F.lit(0)).alias("edges"))


def latency(calls: DataFrame, by: Sequence[str], at: str = "at", ms: str = "ms", failed: str | Column = "failed") -> DataFrame:
    bad = F.col(failed) if isinstance(failed, str) else failed
    return calls.groupBy(*by).agg(F.count("*").alias("attempts"), F.count_if(~bad).alias("completed"), F.count_if(bad).alias("errors"), F.sum(ms).alias("total_ms"), F.max(ms).alias("max_ms"), F.max_by(ms, at).alias("last_ms"))


def freshness(pending: Column, dead: Column, failing: Column) -> Column:
    return F.when((dead > 0) | failing, "DEGRADED").when(pending > 0, "STALE").otherwise("FRESH")


def nearest_ranks(rows: DataFrame, value: str, percents: Sequence[int] = (50, 95), by: Sequence[str] = (), buckets: int = 256, most: int = 1 << 20) -> DataFrame:
    """mean, nearest-rank percentiles and max: the value at rank ceil(p% of n), exactly.

    Values are counted before they are shuffled. A group of at most ``most`` different ones is put in order by one task. For
    others approximate quantiles cut the values into buckets, whose counts tell which bucket holds a rank; only the
    values of that one are then put in order."""
    keys = list(by) or ["_g"]
    held = rows.where(F.col(value).isNotNull()).select(*by, *([] if by else [F.lit(0).alias("_g")]), F.col(value).alias("_v"))
    counts = written(held.groupBy(*keys, "_v").agg(F.count("*").alias("_c")))  # a row per different value
    shape = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), F.max("_v").alias("max"), F.count("*").alias("_d"))
    ranks = shape.select(*keys, "_d", F.explode(F.array(*(F.struct(F.lit(p).alias("_p"), F.greatest(F.lit(1), F.ceil(F.col("_n") * p / 100)).alias("_r")) for p in percents))).alias("x")).select(*keys, "_d", "x.*")

    def found(values: DataFrame, wanted: DataFrame, within: list[str]) -> DataFrame:
        upto = values.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*within).orderBy("_v")))
        return upto.join(wanted, within).where("_r > _upto - _c AND _r <= _upto").select(*keys, "_p", "_v")

    sized = shape.select(*keys, "_d")
    out = found(counts.join(sized.where(F.col("_d") <= most).drop("_d"), keys, "left_semi"), ranks.where(F.col("_d") <= most).drop("_d"), keys)
    large = sized.where(F.col("_d") > most).drop("_d")
    if not large.isEmpty():
        theirs = counts.join(large, keys, "left_semi")
        cuts = theirs.groupBy(*keys).agg(F.percentile_approx("_v", [k / buckets for k in range(1, buckets)], 10_000).alias("_cuts"))
        dealt = theirs.join(cuts, keys).select(*keys, "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_b"))
        below = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sizes = dealt.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(below), F.lit(0)))  # ``buckets`` rows of a group
        wanted = sizes.join(ranks, keys).where("_before < _r AND _r <= _before + _s").select(*keys, "_b", "_p", (F.col("_r") - F.col("_before")).alias("_r"))
        out = out.unionByName(found(dealt.join(wanted.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi"), wanted, [*keys, "_b"]))
    values = out.groupBy(*keys).agg(*(F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(f"p{p}") for p in percents))
    return shape.join(values, keys).select(*by, "mean", *(f"p{p}" for p in percents), "max")


def outcomes(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    return rows.groupBy(outcome).agg(F.count("*").alias("n"))


def scoped_backlog(outbox: DataFrame, documents: DataFrame) -> DataFrame:
    """The backlog of the operations of these documents (id) alone."""
    return backlog(outbox.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi"))
