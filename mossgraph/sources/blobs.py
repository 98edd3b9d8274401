"""Content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(blobs: DataFrame, data: DataFrame, column: str = "bytes") -> DataFrame:
    """``blobs`` and those of ``data`` that it lacks; empty ones are refused as null hashes are: they stay out."""
    new = data.where(F.octet_length(column) > 0).select(F.sha2(column, 256).alias("hash"), F.lit("sha256").alias("algorithm"), F.octet_length(column).cast("long").alias("size"), F.col(column).alias("bytes")).dropDuplicates(["hash"])
    return blobs.unionByName(new.join(blobs.select("hash"), "hash", "left_anti").select(*blobs.columns))


def verified(blobs: DataFrame, size: Column | None = None) -> DataFrame:
    """``blobs`` with ``ok``: the digest is the bytes', and the size too where one of 0 or more is asserted."""
    asserted = F.col("size") if size is None else size
    return blobs.withColumn("ok", (F.sha2("bytes", 256) == F.col("hash")) & ((asserted < 0) | (asserted == F.octet_length("bytes"))))
