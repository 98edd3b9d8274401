"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fewer, written


def _twice(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """a and b of every pair of columns of every row."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs))))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of ``edges`` (a, b); written.

    Each round links nodes to the smallest node known around them; a node with very many edges is
    aggregated before the shuffle and its joins are split by adaptive execution."""
    with Scratch(edges.sparkSession) as scratch:
        now = scratch.written(fewer(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()))
        state = None
        while True:
            both = _twice(now, ("a", "b"), ("b", "a"))
            least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            down = large.groupBy("a").agg(F.min("b").alias("m"))
            small = _twice(large.join(down, "a"), ("b", "m"), ("a", "m")).where("a <> b").distinct()
            now = scratch.written(fewer(small))
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if seen == state:
                break
            state = seen
        both = _twice(now, ("a", "b"), ("b", "b"))
        return written(fewer(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))))
