"""Streams: the outbox drained with retries and dead letters, the change feed, and coalesced file events.

Each has a batch twin in ``operators.changes``; over all the data both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changes import MAX_ATTEMPTS
from ..shared import exists

ATTEMPTS = "document_id long, attempts int, dead boolean, last_id long"


def source(spark: SparkSession, path: str, schema: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet folder, or a single file, as a stream of its files."""
    glob = path[:-1] + f"[{path[-1]}]"  # a file cannot be the base of a stream, a pattern can
    made = spark.readStream.schema(spark.read.parquet(path).schema if schema is None else schema)
    return (made.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else made).parquet(glob)


def attempts(operations: DataFrame) -> DataFrame:
    """Per document: failed deliveries in a row so far, dead once there are too many; a delivery sets it back. Operations: id, document_id, failed.

    Those of a batch count in order of id, after those of earlier batches whatever their ids: a late file counts
    when it comes. A batch that is run again starts from the state before it, so nothing counts twice."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, dead, last = state.get if state.exists else (0, False, -1)
        rows = pd.concat(list(batches)).sort_values("id")
        for failed, id in zip(rows["failed"], rows["id"], strict=True):
            n, last = (n + 1 if failed else 0), max(last, int(id))
            dead = dead or n >= MAX_ATTEMPTS
        state.update((int(n), bool(dead), int(last)))
        yield pd.DataFrame({"document_id": [key[0]], "attempts": [n], "dead": [dead], "last_id": [last]})

    return operations.groupBy("document_id").applyInPandasWithState(step, ATTEMPTS, "attempts int, dead boolean, last_id long", "update", GroupStateTimeout.NoTimeout)


def latest_by_key(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last event of each key so far."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def windowed_counts(events: DataFrame, at: str, by: str, width: str, late: str) -> DataFrame:
    """Changes per window and kind, final once the watermark has passed."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def drained(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs ``stream`` over what is there now and writes it to ``out``; of updates the last batch's rows of a key count, by ``batch``."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}" if mode == "update" else f"{out}/{batch}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def updated(spark: SparkSession, out: str, schema: str, keys: list[str]) -> DataFrame:
    """The final rows of a stream of updates."""
    rows = spark.read.schema(schema + ", batch int").option("recursiveFileLookup", True).parquet(out)
    values = [f.name for f in rows.schema if f.name not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def feed_to(stream: DataFrame, out: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """The change feed: each batch's rows numbered on from those before. A batch that is run again gets the same numbers.

    A row beside each batch holds its last number; the next batch reads that row alone."""
    from ..operators.changes import sequenced

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        last = lambda b: f"{out}_last/{b}"
        start = spark.read.parquet(last(batch - 1)).first()[0] if exists(spark, f"{last(batch - 1)}/_SUCCESS") else 0
        sequenced(rows, order, start).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        spark.read.parquet(f"{out}/batch={batch}").agg(F.coalesce(F.max("sequence"), F.lit(start).cast("long")).alias("last")).write.mode("overwrite").parquet(last(batch))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
