"""Embeddings written once for each content, model and chunk, and joined to whatever documents have the content.

A backfill takes the contents that have no vectors of the model, a share of them at a time by a hash; each share counts once
it is committed, so one that was interrupted goes on where it stopped and one that is run again embeds nothing.
Equal contents are embedded once. Contents without chunks have no vectors and are asked about again. An embedder that returns another
number of vectors, or one of another dimension, is an error and the share has no effect. Null contents are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written
from .segments import Manifest, Spec, Tables, part_of, parts_for

Chunker = Callable[[Column], Column]  #: content to array<string>
Embed = Callable[[list[str]], Sequence[Sequence[float]]]
Observer = Callable[[int, int], None]  #: told of every share: its number, and how many vectors it has written


def whole(content: Column) -> Column:
    return F.array(content)


class EmbeddingPipeline:
    def __init__(self, spark: SparkSession, folder: str, model: str, dim: int, embed: Embed, chunker: Chunker = whole, batch: int = 256):
        self.spark, self.model, self.dim, self.embed, self.chunker, self.batch = spark, model, dim, embed, chunker, batch
        self.tables = Tables(spark, folder, {"vectors": Spec("content_hash", "part")})

    def vectors(self, base: Manifest | None = None) -> DataFrame | None:
        """content_hash, model, chunk, dim and vector of all models; None before the first."""
        rows = self.tables.read(base or self.tables.manifest(), "vectors")
        return None if rows is None else rows.drop("part")

    def missing(self, documents: DataFrame) -> DataFrame:
        """content_hash and content of what has no vectors of the model, each content once."""
        rows = documents.where(F.col("content").isNotNull()).select("content_hash", "content")
        have = self.vectors()
        if have is not None:
            rows = rows.join(have.where(F.col("model") == self.model).select("content_hash").distinct(), "content_hash", "left_anti")
        return rows.dropDuplicates(["content_hash"])

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        embed, dim, batch = self.embed, self.dim, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch].copy()
                    made = [[float(x) for x in v] for v in embed(part["text"].tolist())]
                    if len(made) != len(part) or any(len(v) != dim for v in made):
                        raise ValueError(f"the embedder returned {len(made)} vectors for {len(part)} chunks, of dimensions {sorted({len(v) for v in made})}, not {dim}")
                    part["vector"] = made
                    yield part[["content_hash", "chunk", "vector"]]

        return chunks.mapInPandas(run, "content_hash string, chunk int, vector array<double>")

    def embed_changed(self, documents: DataFrame, share: tuple[int, int] = (0, 1)) -> int:
        """Embeds what is missing of the documents (content_hash, content), or a share (k of n) of it; returns how many vectors are new."""
        k, n = share
        held = written(self.missing(documents.where(F.pmod(F.xxhash64("content_hash"), F.lit(n)) == k)).select("content_hash", F.posexplode(self.chunker(F.col("content"))).alias("chunk", "text")).where("text IS NOT NULL"))
        count = held.count()
        if count:
            rows = self._embedded(held).select("content_hash", F.lit(self.model).alias("model"), "chunk", F.lit(self.dim).alias("dim"), "vector")
            parts = parts_for(count)
            change = self.tables.stage("vectors", rows.withColumn("part", part_of(F.col("content_hash"), parts)), None, parts)
            self.tables.apply(lambda base: change)
        return count

    def backfill(self, documents: DataFrame, shares: int = 1, observer: Observer | None = None) -> int:
        """All documents, a share after the other."""
        total = 0
        for k in range(shares):
            made = self.embed_changed(documents, (k, shares))
            total += made
            if observer:
                observer(k, made)
        return total

    def of(self, documents: DataFrame) -> DataFrame:
        """id, chunk, model, dim and vector of documents (id, content_hash)."""
        return documents.select("id", "content_hash").join(self.vectors().where(F.col("model") == self.model), "content_hash").select("id", "chunk", "model", "dim", "vector")
