"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-case words of a whole text, hashed to ``BINS``. Over all labelled rows of the
training folds each bin is counted, and the bins that tell the classes apart best by the likelihood ratio
become features, scaled by their smoothed log odds. The machine, fitted by Spark on a bounded sample of those
rows, adds to the linear weights an inner product of factors for every pair of features, so that an insult
beside a group's name can weigh more than the two apart.

Labels are learnt only from rows whose crc32(doc_id) mod 5 is not 0. Labels, language, source and id are no
inputs of a score. Null and empty texts have no features and score by the intercept. Of several labels for
one id the greatest counts; rows without an id or a label teach nothing; with no labels at all, or of one class, the score is
the smoothed share of toxic labels.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

BINS = 1 << 18
#: Features at most, and the least likelihood ratio (chi-square, one degree) of one.
FEATURES = 2048
LEAST_RATIO = 12.0
#: Labelled rows, of those that have a feature or not, that the machine is fitted on at most (in expectation).
SAMPLE = 40_000
#: A bin's share of toxic rows is drawn to the overall share as if by so many more rows.
PRIOR_ROWS = 5.0
FACTORS = 4
FOLDS = 5
REMEMBERED = 400_000

_WORDS = regex.compile(r"\p{L}+").findall


def bin_of(word: str) -> int:
    return zlib.crc32(word.encode()) % BINS


def bins_of(text: str | None) -> list[int]:
    return sorted({bin_of(w) for w in set(_WORDS((text or "").lower()))})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


@dataclass(frozen=True)
class Machine:
    index: dict[int, int]  #: bin -> feature
    scale: np.ndarray
    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, features: list[int]) -> float:
        x = self.scale[features]
        v = self.factors[features] * x[:, None]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        z = self.intercept + float(self.linear[features] @ x) + pairs
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, bins and toxic (0 or 1) of the labelled rows of the training folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bins_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "bins"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("bins", T.ArrayType(T.IntegerType(), False))])
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text").mapInArrow(run, schema)
    return rows.join(known.where(~held_out(F.col("doc_id"))).hint("merge"), "doc_id")  # labels grow with the data


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    with Scratch(docs.sparkSession) as scratch:
        return _fitted(scratch, scratch.written(labelled(docs, labels)), sample)


def _fitted(scratch: Scratch, rows: DataFrame, sample: int) -> Machine:
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    base = (toxic + 1) / (n + 2)
    none = Machine({}, np.zeros(0), math.log(base / (1 - base)), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < toxic < n:
        return none

    def part(a: Column, expected: Column) -> Column:
        return F.when(a > 0, a * F.log(a / expected)).otherwise(0.0)

    share = toxic / n
    c, t = F.col("c"), F.col("t")
    ratio = 2 * (part(t, c * share) + part(c - t, c * (1 - share)) + part(toxic - t, (n - c) * share) + part((n - c) - (toxic - t), (n - c) * (1 - share)))
    odds = F.log((t + PRIOR_ROWS * share) / (c - t + PRIOR_ROWS * (1 - share))) - math.log(share / (1 - share))
    counts = rows.select(F.explode("bins").alias("bin"), "toxic").groupBy("bin").agg(F.count("*").alias("c"), F.sum("toxic").alias("t"))
    chosen = counts.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "bin").limit(FEATURES).select("bin", odds.alias("odds")).collect()
    if not chosen:
        return none
    index = {r.bin: k for k, r in enumerate(chosen)}
    scale = np.array([r.odds for r in chosen])
    vocabulary = CountVectorizerModel.from_vocabulary([str(b) for b in index], inputCol="terms", outputCol="found", minTF=1.0)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="found", outputCol="features")
    held = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / n))).select(F.col("bins").cast("array<string>").alias("terms"), F.col("toxic").alias("label"))
    ready = scratch.written(scaled.transform(vocabulary.transform(held)).select("features", "label")).cache()
    model = FMClassifier(factorSize=FACTORS, maxIter=60, stepSize=0.1, regParam=1e-4, initStd=0.05, seed=7).fit(ready)
    ready.unpersist()
    return Machine(index, scale, float(model.intercept), model.linear.toArray(), model.factors.toArray())


def scored(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with its score; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != out]
    at = kept.index(text)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, {}
        for batch in batches:
            scores = []
            for t in batch.column(at).to_pylist():
                words = set(_WORDS((t or "").lower()))
                if len(known) > REMEMBERED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = own.index.get(bin_of(w), -1)
                scores.append(own.score(sorted({f for w in words if (f := known[w]) >= 0})))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*kept, out])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def per_document(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
