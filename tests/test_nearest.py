"""Exact neighbours by parts with bounds against plain code, and what the bounds save."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import nearest, retrieval


def plain(rows, asked, k, metric):
    def score(q, v):
        n = min(len(q), len(v))
        a, b = np.array(q[:n]), np.array(v[:n])
        if metric == "cosine":
            return 0.0 if not (a @ a) * (b @ b) else float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))
        return 1 / (1 + float(((b - a) ** 2).sum()))

    out = []
    for qid, q in asked:
        if q is not None:
            best = sorted((-round(score(q, v), 9), i is not None, i or 0) for i, v in rows if v is not None)[:k]
            out += [(qid, i if known else None, r) for r, (_, known, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def found(spark, rows, asked, k, metric):
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, vector array<double>, block string, score int")
    queries = spark.createDataFrame([(i, v, "y") for i, v in asked], "qid long, vector array<double>, list string")
    out = nearest.knn(vectors, queries, k, metric)
    assert out.columns == ["qid", "id", "score", "rank"]
    return sorted(((r.qid, r.id, r["rank"]) for r in out.collect()), key=str)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_against_plain_code(spark, monkeypatch, metric):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "QUERIES_A_TASK", 3)
    g = np.random.default_rng(2)
    rows = [(i, (g.normal(size=4) + 6 * np.eye(4)[i % 4]).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]  # a large group of equal vectors
    rows += [(2000 + i, g.normal(size=3).tolist()) for i in range(6)] + [(None, [0.5, 0.5, 0.0, 0.0]), (3000, None), (3001, [0.0] * 4), (3002, [0.0] * 4)]
    asked = [(i, (g.normal(size=4) + 6 * np.eye(4)[i % 4]).tolist()) for i in range(30)]
    asked += [(90, [1.0, 2.0, 3.0, 4.0]), (91, None), (92, [0.0] * 4), (93, [1.0, 1.0]), (94, [1.0] * 6)]
    assert found(spark, rows, asked, 7, metric) == plain(rows, asked, 7, metric)


def test_no_rows(spark):
    assert found(spark, [], [(1, [1.0])], 3, "l2") == [] and found(spark, [(1, [1.0])], [], 3, "l2") == []
    assert found(spark, [(1, [1.0])], [(1, [2.0])], 3, "l2") == [(1, 1, 1)]


def test_blocks_are_skipped(spark, monkeypatch):
    """Clustered vectors: a query opens a small share of the blocks, and the result is exact."""
    monkeypatch.setattr(nearest, "BLOCK", 64)
    v = spark.range(6000).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (F.pmod(F.xxhash64("id", j), F.lit(1000)) / 1000.0 + 20 * F.pmod(F.xxhash64(F.col("id") % 30, j), F.lit(5))).cast("double")).alias("vector"))
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    parts = nearest.build(v, 5)
    _, first, later = nearest.opened(parts, q)
    blocks, visits = parts.blocks.count(), first.count() + later.count()
    assert visits < 0.2 * blocks * q.count(), (blocks, visits)
    wanted = {(r.qid, r.id) for r in retrieval.knn(v, q, 5).collect()}
    assert {(r.qid, r.id) for r in nearest.search(parts, q).collect()} == wanted


def test_a_query_travels_once_to_a_part(spark, monkeypatch):
    """Vectors without clusters, so bounds save nothing: no row for a query and a block, and no score below the k-th of the first round."""
    monkeypatch.setattr(nearest, "BLOCK", 32)
    monkeypatch.setattr(nearest, "PART_ROWS", 1000)
    g = np.random.default_rng(4)
    v = spark.createDataFrame([(i, g.normal(size=16).tolist()) for i in range(3000)], "id long, vector array<double>")
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    parts = nearest.build(v, 5)
    begun, first, later, asked = nearest._rounds(parts, q, True)
    count = int(parts.rings.part.max()) + 1
    assert 3 <= count <= 5 and len(parts.rings.n) > 10 * count
    assert first.count() <= asked * count and later.count() <= asked * count
    kth = begun.groupBy("qid").agg(F.sort_array(F.collect_list("score"), False)[4].alias("kth"))
    assert nearest._scored(parts, later, asked, True).join(kth, "qid").where("score < kth").count() == 0
    assert sorted(map(tuple, nearest.search(parts, q).collect())) == sorted(map(tuple, retrieval.knn(v, q, 5).collect()))


def test_what_a_task_sends_at_once_is_bounded():
    """a batch of 3,000 queries leaves a task in batches of some queries, each with its vector once for a part."""
    lists, dim = 40, 16
    g = np.random.default_rng(5)
    known = nearest.Rings(g.normal(size=(lists, dim)), np.arange(lists), np.full(lists, 100), np.tile([0.0, 9.0], (lists, 1)), np.arange(lists) // 10, 5, "cosine", 200)
    batch = pa.record_batch([pa.array(range(3000)), pa.array(g.normal(size=(3000, dim)).tolist()), pa.nulls(3000, pa.float64())], names=["qid", "vector", "kth"])
    sent = list(nearest._sent(known, True, False)(iter([batch])))
    assert sum(b.num_rows for b in sent) <= 3000 * 4 and max(b.num_rows for b in sent) <= nearest.TOGETHER * 4
