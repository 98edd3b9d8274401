import math
import random

import numpy as np
import pytest
from conftest import SF
from mossgraph.operators import ann
from mossgraph.operators.ann import VectorIndex, recall
from mossgraph.operators.search import vector_scores
from mossgraph.shared import shared_folder
from mossgraph.sources.adapters import vectors
from pyspark.sql import functions as F

SCHEMA = "id long, collection int, vector array<float>"


def brute(rows, q, limit, keep=lambda r: True):
    q = np.array(q) / np.linalg.norm(q)
    best = {}
    for i, c, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and keep((i, c)):
            v = np.array(v, np.float32).astype(float)
            best[i] = max(best.get(i, -1), (1 + float(v @ q) / np.linalg.norm(v)) / 2)
    return sorted(((i, round(s, 9)) for i, s in best.items()), key=lambda x: (-x[1], x[0]))[:limit]


def cloud(n, d=12, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, d)) * 2
    return [(i, i % 4, (centres[i % 6] + r.standard_normal(d)).astype(np.float32).tolist()) for i in range(n)]


def test_exact_answers_through_changes(spark):
    rows = cloud(400) + [(900 + i, 1, [1.0] * 12) for i in range(30)] + [(1000, 0, None), (1001, 0, [0.0] * 12), (1002, 0, [float("nan")] * 12), (5, 1, [2.0] * 12)]
    index = VectorIndex(spark, shared_folder(spark), cells=9).build(spark.createDataFrame(rows, SCHEMA))
    r = random.Random(1)
    for step in range(3):
        if step:
            new = [(i, 2, [r.gauss(0, 1) for _ in range(12)]) for i in r.sample(range(700), 40)]
            gone = r.sample(range(900, 930), 5)
            index.add(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([(g,) for g in gone], "id long"))
            rows = [x for x in rows if x[0] not in {n[0] for n in new} | set(gone)] + new
        queries = [rows[k][2] for k in (3, 77, 200)] + [[1.0] * 12, [-1.0] + [0.0] * 11]
        for keep, wanted in ((None, lambda x: True), (F.col("collection") == 1, lambda x: x[1] == 1)):
            got = index.exact(queries, 7, keep).collect()
            for n, q in enumerate(queries):
                mine = sorted(((x.id, round(x.score, 9)) for x in got if x.q == n), key=lambda x: (-x[1], x[0]))
                assert mine == brute(rows, q, 7, wanted)
    before = sorted(map(tuple, index.exact(queries, 7).select("q", "id").collect()))
    index.add(spark.createDataFrame([], SCHEMA)).add(spark.createDataFrame([], SCHEMA)).compact()
    assert sorted(map(tuple, index.exact(queries, 7).select("q", "id").collect())) == before and len(index.tables.manifest().segments["codes"]) < 3


def test_recall_over_queries(spark):
    """Recall at 10 over 250 rows, beside the exact scan; a search reads the cells that it probes."""
    rows = vectors(spark, SF.replace("0.001", "0.1"))
    index = VectorIndex(spark, shared_folder(spark)).build(rows)
    asked = rows.where("id % 8 = 0").select("id", "vector")
    truth = index.in_blocks(asked, lambda q: index.exact(q, 10)).withColumnRenamed("qid", "qid")
    found = index.in_blocks(asked, lambda q: index.near(q, 10))
    got = recall(found, truth).first()
    assert got.queries == 250 and got.recall >= 0.9
    assert 0 < index.tables.manifest().info["probes"] <= len(index.tables.manifest().info["centroids"])
    one = rows.where("id = 8").first()
    scan = vector_scores(rows, list(one.vector)).orderBy(F.desc("score"), "id").limit(10).collect()
    assert [r.id for r in truth.where("qid = 8").orderBy(F.desc("score"), "id").collect()] == [r.id for r in scan]
    plan = index.near([list(one.vector)], 10, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_clusters_need_few_probes(spark):
    index = VectorIndex(spark, shared_folder(spark), cells=12).build(spark.createDataFrame(cloud(1500), SCHEMA))
    assert index.tables.manifest().info["probes"] <= 6


def test_edges(spark):
    none = VectorIndex(spark, shared_folder(spark)).build(spark.createDataFrame([], SCHEMA))
    assert none.exact([[1.0]], 3).count() == 0 and none.near([[1.0]], 3).count() == 0
    same = VectorIndex(spark, shared_folder(spark)).build(spark.createDataFrame([(i, 0, [1.0, 2.0]) for i in range(50)], SCHEMA))
    assert [r.id for r in same.exact([[1.0, 2.0]], 5).orderBy("id").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="another dimension"):
        same.add(spark.createDataFrame([(1, 0, [1.0])], SCHEMA))
    with pytest.raises(ValueError, match="block"):
        same.near([[1.0, 2.0]] * (ann.BLOCK + 1), 1)


def test_many_queries_are_few_passes(spark):
    """Queries by the thousand are searched together, and each has the answer that it has alone."""
    rows = spark.createDataFrame(cloud(3000), SCHEMA)
    index, blocks = VectorIndex(spark, shared_folder(spark), cells=9).build(rows), []
    truth = index.in_blocks(rows.select("id", "vector"), lambda q: blocks.append(len(q)) or index.exact(q, 5)).cache()
    assert sum(blocks) == 3000 and len(blocks) <= 2
    found = index.in_blocks(rows.select("id", "vector"), lambda q: index.near(q, 5, probes=9))
    assert recall(found, truth).first().recall >= 0.99
    for n in (0, 1500, 2999):
        mine = sorted(((r.id, round(r.score, 9)) for r in truth.where(F.col("qid") == n).collect()), key=lambda x: (-x[1], x[0]))
        assert mine == brute(cloud(3000), cloud(3000)[n][2], 5)
