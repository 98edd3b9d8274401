"""A stored vector index: an inverted file over k-means cells, with codes of a byte a dimension and exact re-ranking.

Cells are learnt on a bounded sample and stay; every vector is put into the cell of the nearest centroid. Codes and
vectors are segments partitioned by cell, so a search reads the cells that it probes, ranks them by code and reads the exact
vectors of the candidates alone. Vectors come and go by segments, without a rebuild.

A search has a block of queries, which every task gets, and each task ranks the rows that it reads for all of them, a tile at a time: a cell
may hold any share of the rows and is read by many tasks. Two kinds of answer: ``near`` probes as many cells as
reached ``TARGET`` of the true neighbours of a sample of rows at the build, and ``exact`` goes on to every cell that could have a
better one, by the angle of the cell's farthest vector, and keeps every code whose error could hide one.

Scores are (1 + cosine) / 2. Null vectors, those of length 0 and those with entries that are null or not finite are not in the index; vectors of another
dimension than the first are an error. The best chunk of an id counts; ties go to the lesser id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .segments import Change, Manifest, Spec, Tables

SPECS = {"codes": Spec("id", "cell"), "vectors": Spec("id", "cell")}
#: Cells at most; rows of the sample per cell (in expectation); queries of a block, which are compared ``TILE`` at a time; candidates for each hit asked for; queries that set the number of probes, and the share of true neighbours to reach.
MOST_CELLS, SAMPLE_A_CELL, BLOCK, CANDIDATES, TRIALS, TARGET = 4096, 64, 1 << 14, 4, 256, 0.97
TILE = 1024
#: Entries of a matrix of queries and cells on the driver, and candidates that a task holds before it drops the worse ones.
ENTRIES, HELD = 1 << 23, 1 << 21


def unit(column: str = "vector") -> tuple[Column, Column]:
    """Whether a vector can be indexed, and it at length 1."""
    v = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    fit = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))) & (norm > 0) & (norm < float("inf"))
    return F.coalesce(fit, F.lit(False)), F.transform(v, lambda x: x / norm)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class VectorIndex:
    """Rows have id, vector and ``attributes``, which filters may name."""

    def __init__(self, spark: SparkSession, folder: str, attributes: Sequence[str] = ("collection",), cells: int | None = None):
        self.spark, self.tables, self.attributes, self.cells = spark, Tables(spark, folder, SPECS), tuple(attributes), cells

    # changes

    def build(self, rows: DataFrame) -> VectorIndex:
        """Learns cells on a sample of ``rows``, adds them all and sets the number of probes."""
        fit, made = unit()
        units = rows.where(fit).select("id", made.alias("u"))
        n = units.count()
        k = min(MOST_CELLS, self.cells or max(1, math.isqrt(n)))
        share = min(1.0, SAMPLE_A_CELL * k / max(1, n))
        sample = units.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else units
        centroids = np.zeros((1, 1))
        if n:
            model = KMeans(k=k, maxIter=8, seed=3, distanceMeasure="cosine", featuresCol="f").fit(sample.select(array_to_vector("u").alias("f")).repartition(max(1, k * SAMPLE_A_CELL // 20_000)))
            centroids = np.array(model.clusterCenters())
            centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        info = {"centroids": centroids.tolist(), "radius": [0.0] * len(centroids), "probes": len(centroids)}
        self.tables.apply(lambda base: Change(info=info))
        self.add(rows)
        probes = self.probes_for(TARGET)
        self.tables.apply(lambda base: Change(info={"probes": probes}))
        return self

    def add(self, rows: DataFrame, removed: DataFrame | None = None) -> VectorIndex:
        """``rows`` come or take the place of what their ids had; ``removed`` (id) go. Cells stay, and reach as far as their farthest vector."""
        centroids = np.array(self.tables.manifest().info["centroids"])
        d, fit_made = centroids.shape[1], unit()
        same = F.when(F.size("vector") == d, True).otherwise(F.raise_error(F.lit("vector of another dimension")).cast("boolean"))
        good = rows.where(fit_made[0] & same).select("id", *self.attributes, "vector", fit_made[1].alias("u"))
        schema = T.StructType([good.schema["id"], *(good.schema[a] for a in self.attributes), good.schema["vector"], T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("error", T.DoubleType()), T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                u = _matrix(batch.column(batch.num_columns - 1))
                near = u @ centroids.T
                cell = near.argmax(axis=1)
                scale = np.abs(u).max(axis=1) / 127
                code = np.rint(u / scale[:, None]).astype(np.int8)
                error = np.linalg.norm(u - code * scale[:, None], axis=1)  # of any product with a unit vector
                angle = np.arccos(np.clip(near[np.arange(len(u)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c.tobytes() for c in code]), pa.array(scale), pa.array(error), pa.array(angle), pa.array(cell, pa.int32())], schema.fieldNames())

        gone = rows.select("id") if removed is None else rows.select("id").unionByName(removed.select("id"))
        made = self.tables.stage("vectors", good.mapInArrow(run, schema), gone, len(centroids))
        written = self.tables.read(Manifest(0, made.segments, made.schemas), "vectors")
        made += self.tables.stage("codes", written.select("id", *self.attributes, "code", "scale", "error", "cell"), gone, len(centroids))
        reach = {r.cell: r.a for r in written.groupBy("cell").agg(F.max("angle").alias("a")).collect()}  # a row per cell
        self.tables.apply(lambda base: made + Change(info={"radius": [max(a, reach.get(c, 0.0)) for c, a in enumerate(base.info["radius"])]}))
        return self

    def compact(self) -> VectorIndex:
        self.tables.compact("vectors")
        self.tables.compact("codes")
        return self

    # searching

    def _coded(self, base: Manifest, queries: np.ndarray, probed: np.ndarray, keep: Column | None, most: int | None, floors: np.ndarray | None) -> DataFrame:
        """q, id, cell of the rows of the probed cells (a flag per query and cell): the ``most`` best by code of each query, or all that could reach its floor."""
        cells = np.flatnonzero(probed.any(axis=0)).tolist()
        rows = self.tables.read(base, "codes", lambda r, s: r.where(F.col("cell").isin(*cells)) if cells else r.limit(0))
        rows = (rows.where(keep) if keep is not None else rows).select("id", "code", "scale", "error", "cell")
        schema = T.StructType([T.StructField("q", T.IntegerType()), rows.schema["id"], T.StructField("cell", T.IntegerType()), T.StructField("approx", T.DoubleType())])
        arrow, d = to_arrow_schema(schema), queries.shape[1]

        def best(held: list[pa.Table]) -> pa.Table:
            table = pa.concat_tables(held)
            if most is None or table.num_rows <= most:
                return table
            q, a = table.column("q").to_numpy(), table.column("approx").to_numpy()
            order = np.lexsort((-a, q))
            first = np.searchsorted(q[order], q[order])
            return table.take(pa.array(order[np.arange(len(order)) - first < most]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            least = np.full(len(queries), -np.inf) if floors is None else floors - 1e-9  # of the held ones, once a query has as many as are asked for
            for batch in batches:
                if not batch.num_rows:
                    continue
                u = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(-1, d)
                scale, error, cell = (batch.column(c).to_numpy() for c in (2, 3, 4))
                for c in np.unique(cell):
                    of, at = np.flatnonzero(probed[:, c]), np.flatnonzero(cell == c)
                    vectors = u[at].astype(np.float64) * scale[at, None]
                    for first in range(0, len(of), TILE):
                        asking = of[first : first + TILE]
                        a = vectors @ queries[asking].T
                        rows_, cols = np.nonzero((a if floors is None else a + error[at, None]) >= least[asking])
                        if most is not None and floors is None and len(at) > most and len(rows_) > most * len(asking):  # of each query in the cell
                            rows_ = np.argpartition(-a, most - 1, axis=0)[:most]
                            cols = np.broadcast_to(np.arange(a.shape[1]), rows_.shape).ravel()
                            rows_ = rows_.ravel()
                        held.append(pa.Table.from_arrays([pa.array(asking[cols], pa.int32()), batch.column(0).take(pa.array(at[rows_])), pa.array(np.full(len(rows_), c), pa.int32()), pa.array(a[rows_, cols])], schema=arrow))
                        if floors is None and sum(x.num_rows for x in held) > max(HELD, 2 * (most or 0) * len(queries)):
                            held = [best(held)]
                            q, approx = held[0].column("q").to_numpy(), held[0].column("approx").to_numpy()
                            full = np.bincount(q, minlength=len(queries)) >= most
                            worst = np.full(len(queries), np.inf)
                            np.minimum.at(worst, q, approx)
                            least = np.where(full, worst, -np.inf)
                if floors is not None and held:
                    yield from pa.concat_tables(held).to_batches()
                    held = []
            if held:
                yield from best(held).to_batches()

        found = rows.mapInArrow(run, schema)
        if most is None:
            return found
        return found.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("approx"), "id"))).where(F.col("_n") <= most).drop("_n")

    def _ranked(self, base: Manifest, queries: np.ndarray, candidates: DataFrame, limit: int) -> DataFrame:
        """q, id, cell, score: the best of the candidates by their exact vectors."""
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        asked = self.spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "q int, _q array<double>")
        vectors = self.tables.read(base, "vectors", lambda r, s: r.select("id", "cell", "vector"))
        rows = vectors.join(candidates.select("q", "id", "cell").distinct(), ["cell", "id"]).join(F.broadcast(asked), "q")
        v, q = F.col("vector"), F.col("_q")
        rows = rows.withColumn("score", (1 + dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))) / 2)
        best = rows.groupBy("q", "id").agg(F.max("score").alias("score"), F.max_by("cell", "score").alias("cell"))
        return best.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= limit).drop("_n")

    def _block(self, vectors: Sequence[Sequence[float]]) -> np.ndarray:
        if len(vectors) > BLOCK:
            raise ValueError(f"more than {BLOCK} queries in a block")
        q = np.array(vectors, float).reshape(len(vectors), -1)
        return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def near(self, vectors: Sequence[Sequence[float]], limit: int, keep: Column | None = None, probes: int | None = None, base: Manifest | None = None) -> DataFrame:
        """q (the number of a query), id, cell and score: the best of the cells probed."""
        base = base or self.tables.manifest()
        queries, centroids = self._block(vectors), np.array(base.info["centroids"])
        probed = np.zeros((len(queries), len(centroids)), bool)
        order = np.argsort(-(queries @ centroids.T), axis=1)[:, : probes or base.info["probes"]]
        np.put_along_axis(probed, order, True, axis=1)
        return self._ranked(base, np.array(vectors, float), self._coded(base, queries, probed, keep, CANDIDATES * limit, None), limit)

    def exact(self, vectors: Sequence[Sequence[float]], limit: int, keep: Column | None = None) -> DataFrame:
        """The same over all vectors: what an answer of ``near`` leaves possible is looked up too."""
        base = self.tables.manifest()
        queries, centroids = self._block(vectors), np.array(base.info["centroids"])
        first = self.near(vectors, limit, keep, base=base)
        floors = np.full(len(queries), -1.0)
        for r in first.groupBy("q").agg(F.min("score").alias("s"), F.count("*").alias("n")).collect():  # a row per query of the block
            if r.n >= limit:
                floors[r.q] = 2 * r.s - 1
        angle = np.arccos(np.clip(queries @ centroids.T, -1, 1))
        possible = angle - np.array(base.info["radius"]) <= np.arccos(np.clip(floors, -1, 1))[:, None] + 1e-6
        return self._ranked(base, np.array(vectors, float), self._coded(base, queries, possible, keep, None, floors), limit)

    def in_blocks(self, queries: DataFrame, search: Callable[[list[list[float]]], DataFrame]) -> DataFrame:
        """``search`` over any number of queries (id, vector), a block at a time: qid and what it gives. Each block is a pass over the cells that it probes."""
        size = min(BLOCK, max(TILE, ENTRIES // max(1, len(self.tables.manifest().info["centroids"]))))
        blocks = max(1, -(-queries.count() * 2 // size))
        out = None
        for b in range(blocks):
            held = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()  # about half a block
            for at in range(0, len(held), size):
                part = held[at : at + size]
                names = self.spark.createDataFrame([(i, r["id"]) for i, r in enumerate(part)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("qid", queries.schema["id"].dataType)]))
                found = search([list(r["vector"]) for r in part]).join(F.broadcast(names), "q").drop("q")
                out = found if out is None else out.unionByName(found)
        return out

    def trials(self, limit: int = 10) -> DataFrame:
        """About ``TRIALS`` indexed rows (id, vector), drawn by a hash."""
        rows = self.tables.read(self.tables.manifest(), "vectors")
        n = rows.count()
        return rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int(min(1.0, TRIALS / max(1, n)) * (1 << 20))).select("id", "vector")

    def probes_for(self, target: float, limit: int = 10) -> int:
        """How many cells reach ``target`` of the true neighbours of a sample of rows."""
        centroids = np.array(self.tables.manifest().info["centroids"])
        held = self.trials().limit(BLOCK).collect()  # about TRIALS
        if not held:
            return len(centroids)
        vectors = [list(r["vector"]) for r in held]
        place = np.argsort(np.argsort(-(self._block(vectors) @ centroids.T), axis=1), axis=1)
        ranks = np.sort([place[r.q, r.cell] for r in self.exact(vectors, limit).collect()])
        return int(ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)]) + 1


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """queries and recall: the share of ``truth`` (qid, id) that is ``found``."""
    hit = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("_h")), ["qid", "id"], "left")
    return hit.agg(F.countDistinct("qid").alias("queries"), F.avg(F.coalesce("_h", F.lit(0))).alias("recall"))
