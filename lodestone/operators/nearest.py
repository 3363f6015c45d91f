"""Exact nearest neighbours by parts with bounds, for any number of queries.

Vectors lie in blocks: those of one centroid, sorted by their distance to it, so that a block is a ring. By
the triangle inequality a query at distance d of the centroid is no nearer to a ring from lo to hi
than max(0, d - hi, lo - d). A first round opens the best bounded rings of each query until they hold k
vectors, and ``FIRST_BLOCKS`` full blocks; a second one opens only those others that can still improve the k-th score.
Blocks are dealt out as parts of about ``PART_ROWS`` vectors. A query travels once to a part that holds some of its blocks, and a
part gives no row below the k-th score of the first round: no row is made of a query and a block. What is computed still grows
as queries times the vectors of their blocks, as it must where bounds don't part them.

Large groups: of equal vectors the k least ids are kept, as no others can be among the k best; a limit of
the groups in map tasks sees to that before they shuffle. A list of any size is cut into rings by range, and a
part is dealt out with a share of ``QUERIES_A_TASK`` queries each.

Defined cases: null vectors on either side never match; vectors of another length than most, and zero
vectors by cosine, are in a ring without bounds, which every query opens, and scores compare over the shorter
length; a query of another length opens every ring; ties go by id; numbers must be finite; empty
tables give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import ann, retrieval
from lodestone.sources.staging import stage

BLOCK, FIRST_BLOCKS, PART_ROWS = 2048, 4, 16_384
QUERIES_A_TASK, TOGETHER = 16_384, 128
SLACK = 1e-6


@dataclass
class Rings:
    """The centroids, and for each block its list, its number of vectors, its ring and its part; the last list has no bounds."""

    centroids: np.ndarray
    list: np.ndarray
    n: np.ndarray
    rings: np.ndarray  # lo and hi of each block
    part: np.ndarray
    k: int
    metric: str
    first: int  # vectors that the first round opens for a query, at least

    def distances(self, vectors: list) -> np.ndarray:
        """Distances of queries to the centroids of the blocks; bounds are left out where a query has another length."""
        out = np.full((len(vectors), len(self.centroids) + 1), np.nan)
        same = [i for i, v in enumerate(vectors) if len(v) == self.centroids.shape[1]]
        if same:
            q = np.array([vectors[i] for i in same], np.float64)
            if self.metric == "cosine":
                q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for i, x in zip(same, q, strict=True):
                out[i, :-1] = np.sqrt(((self.centroids - x) ** 2).sum(1))
        return out[:, self.list]

    def least(self, d: np.ndarray) -> np.ndarray:
        """For each query and block no more than the distance to any of its vectors."""
        out = np.maximum(d - self.rings[:, 1], self.rings[:, 0] - d) - SLACK * (1 + np.abs(d))
        return np.nan_to_num(np.maximum(out, 0.0), nan=0.0)


@dataclass
class Parts:
    """Blocks (block, list, n, lo, hi, ids, vectors, with ``at``, their place among all, and ``part``) and what is known of them."""

    blocks: DataFrame
    rings: Rings


def best_score(least, metric: str, squared: bool):
    """No less than the score of a vector at a distance of ``least`` at least."""
    if metric == "cosine":
        return 1 - least * least / 2 + 1e-9
    return 1 / (1 + (least * least if squared else least)) + 1e-9


def build(vectors: DataFrame, k: int, metric: str = "l2") -> Parts:
    """Parts of ``vectors(id, vector)`` for searches of up to ``k`` neighbours, staged."""
    number = "float" if vectors.schema["vector"].dataType.simpleString() == "array<float>" else "double"
    given = vectors.select("id", F.col("vector").cast(f"array<{number}>").alias("vector")).where("vector IS NOT NULL")
    kind = given.schema["id"].dataType.simpleString()
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = stage(given.withColumn("__copy", copy).where(F.col("__copy") <= k).drop("__copy"), "vectors")
    usual = few.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if usual is None:
        none = np.empty(0, np.int64)
        return Parts(few.selectExpr("0L AS block", "0 AS list", "0 AS n", "0D AS lo", "0D AS hi", "array(id) AS ids", "array(vector) AS vectors", "0 AS at", "0 AS part"), Rings(np.empty((0, 0)), none, none, np.empty((0, 2)), none, k, metric, 0))
    dim, rows = usual["size"], usual["n"]
    some = ann.sample_of(few.where(F.size("vector") == dim), ["vector", "id"], rows)
    sample = _unit(np.array(some, np.float64).reshape(len(some), dim), metric)
    centroids = ann.centroids_of(sample, max(1, min(ann.MOST_LISTS, math.isqrt(rows))))
    odd = len(centroids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, size = retrieval._matrix(b.column(1))
            v = v[:, :dim] if v.shape[1] >= dim else np.pad(v, ((0, 0), (0, dim - v.shape[1])))
            unit = _unit(v, metric)
            near = ann._nearest(unit, centroids, 1)[:, 0]
            far = np.sqrt(((unit - centroids[near]) ** 2).sum(1))
            apart = (size != dim) | ((metric == "cosine") & ~v.any(axis=1))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.where(apart, odd, near), pa.int32()), pa.array(np.where(apart, 0.0, far))], names=["id", "vector", "list", "far"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held, key = TaskContext.get().partitionId() << 32, 0, [], None

        def block() -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(held).combine_chunks()
            far = t.column("far").to_numpy()
            columns = [pa.array([base + made], pa.int64()), pa.array([key], pa.int32()), pa.array([len(far)], pa.int32()), pa.array([far.min()]), pa.array([far.max()])]
            whole = [pa.ListArray.from_arrays(pa.array([0, len(far)], pa.int32()), c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in (t.column("id"), t.column("vector"))]
            made += 1
            held.clear()
            return pa.record_batch(columns + whole, names=["block", "list", "n", "lo", "hi", "ids", "vectors"])

        for b in batches:
            lists = b.column("list").to_numpy()
            cuts = np.flatnonzero(lists[1:] != lists[:-1]) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lists)], strict=True):
                while a < z:
                    if held and (key != lists[a] or sum(x.num_rows for x in held) >= BLOCK):
                        yield block()
                    take = min(z - a, BLOCK - sum(x.num_rows for x in held))
                    key = int(lists[a])
                    held.append(b.slice(a, take))
                    a += take
        if held:
            yield block()

    parts = max(1, int(few.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    rings = few.mapInArrow(placed, f"id {kind}, vector array<{number}>, list int, far double").repartitionByRange(parts, "list", "far", "id").sortWithinPartitions("list", "far", "id")
    blocks = stage(rings.mapInArrow(packed, f"block long, list int, n int, lo double, hi double, ids array<{kind}>, vectors array<array<{number}>>"), "vector-blocks")
    heads = blocks.select("block", "list", "n", "lo", "hi").orderBy("list", "lo", "block").collect()  # five numbers for each ``BLOCK`` vectors
    part, held = np.zeros(len(heads), np.int32), 0
    for i, r in enumerate(heads):
        part[i] = part[i - 1] + (held + r["n"] > PART_ROWS)
        held = r["n"] + (held if part[i] == part[i - 1] and i else 0)
    places = few.sparkSession.createDataFrame([(r["block"], i, int(part[i])) for i, r in enumerate(heads)], "block long, at int, part int")
    known = Rings(centroids, np.array([r["list"] for r in heads]), np.array([r["n"] for r in heads]), np.array([(r["lo"], r["hi"]) for r in heads]), part, k, metric, max(k, FIRST_BLOCKS * BLOCK))
    return Parts(blocks.join(F.broadcast(places), "block"), known)


def _unit(v: np.ndarray, metric: str) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) if metric == "cosine" else v


def _firsts(parts: Rings, least: np.ndarray) -> np.ndarray:
    """Blocks that queries open at first: the best bounded ones that hold enough vectors."""
    order = np.argsort(least, axis=1, kind="stable")
    held = parts.n[order]
    out = np.zeros(least.shape, bool)
    np.put_along_axis(out, order, np.cumsum(held, axis=1) - held < parts.first, axis=1)
    return out


def _sent(parts: Rings, squared: bool, first: bool):
    """A row for each query and part of which it opens blocks: at first the best bounded ones, then those others that can improve the k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows if len(parts.n) else 0, TOGETHER):
                b = whole.slice(i, TOGETHER)
                least = parts.least(parts.distances(b.column(1).to_pylist()))
                opens = _firsts(parts, least)
                if not first:
                    kth = np.nan_to_num(b.column(2).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
                    opens = (best_score(least, parts.metric, squared) >= kth[:, None]) & ~opens
                row, block = np.nonzero(opens)
                part = parts.part[block]
                cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])])) if len(row) else np.empty(0, np.int64)
                own = pa.ListArray.from_arrays(pa.array(np.append(cut, len(row)), pa.int32()), pa.array(block, pa.int32()))
                took = pa.array(row[cut])
                kths = pa.nulls(len(cut), pa.float64()) if first else b.column(2).take(took)
                yield pa.record_batch([b.column(0).take(took), b.column(1).take(took), kths, pa.array(part[cut], pa.int32()), own], names=["qid", "vector", "kth", "part", "blocks"])

    return run


def _met(parts: Rings, squared: bool):
    """Parts of vectors, each before the queries that open it, to the k best of each query's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, ready = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("part", "share", "what")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, z in itertools.pairwise([0, *cuts.tolist(), b.num_rows] if b.num_rows else []):
                if tuple(keys[:2, a]) != group:
                    group, waiting, ready = tuple(keys[:2, a]), [], None
                if keys[2, a] == 0:
                    waiting.append(b.slice(a, z - a))
                    continue
                if ready is None and waiting:
                    t = pa.Table.from_batches(waiting).combine_chunks()
                    ids, vectors, blocks = (pa.concat_arrays(t.column(c).chunks) for c in ("id", "vector", "lead"))
                    ready, waiting = (ids, retrieval._rank(ids), blocks.to_numpy(), *retrieval._matrix(vectors)), []
                for i in range(a, z if ready else a, TOGETHER):
                    yield _within(parts, b.slice(i, min(TOGETHER, z - i)), *ready, squared)

    return run


def _within(parts: Rings, asked: pa.RecordBatch, ids: pa.Array, order: np.ndarray, own: np.ndarray, v: np.ndarray, v_size: np.ndarray, squared: bool) -> pa.RecordBatch:
    """The k best of some queries among the vectors of their blocks, none worse than a known k-th score.

    Matrix products only choose, with room for what they round; scores come from the numbers themselves.
    """
    lists, k = asked.column("blocks"), parts.k
    opens = np.zeros((asked.num_rows, len(parts.n)), bool)
    opens[np.repeat(np.arange(asked.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
    used = np.flatnonzero(opens.any(axis=0)[own])
    order, own, v, v_size = order[used], own[used], v[used], v_size[used]
    q, q_size = retrieval._matrix(asked.column("vector"))
    kth = asked.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
    cosine = parts.metric == "cosine"
    cost, room = np.empty((len(q), len(v))), np.zeros(len(q))
    for n in np.unique(q_size):
        mine = np.flatnonzero(q_size == n)
        for m in np.unique(v_size):
            other = np.flatnonzero(v_size == m)
            x, y = q[mine][:, : min(n, m)], v[other][:, : min(n, m)]
            xx, yy = (x * x).sum(1), (y * y).sum(1)
            product = x @ y.T
            if cosine:
                scale = np.sqrt(xx)[:, None] * np.sqrt(yy)[None]
                product = -np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)
                slack = np.full(len(x), 1e-10)
            else:
                product *= -2
                product += xx[:, None]
                product += yy[None]
                slack = 1e-10 * (1 + xx + yy.max())
            room[mine] = np.maximum(room[mine], slack)
            if len(mine) == len(q) and len(other) == len(v):
                cost = product
            else:
                cost[np.ix_(mine, other)] = product
    cost[~opens[:, own]] = np.inf
    with np.errstate(divide="ignore", invalid="ignore"):
        limit = -kth if cosine else (1 / kth - 1 if squared else (1 / kth - 1) ** 2)
    limit = np.where(np.isnan(limit), np.inf, limit + room + (0 if cosine else 1e-10 * np.nan_to_num(limit, posinf=0.0)))
    near = (cost <= limit[:, None]) & (cost < np.inf)
    for i in np.flatnonzero(near.sum(axis=1) > 2 * k):
        near[i] &= cost[i] <= np.partition(cost[i], k - 1)[k - 1] + 2 * room[i]
    row, at = np.nonzero(near)
    score = np.empty(len(row))
    for i in range(0, len(row), 65536):
        r, c = row[i : i + 65536], at[i : i + 65536]
        size = np.minimum(q_size[r], v_size[c])
        for n in np.unique(size):
            some = np.flatnonzero(size == n)
            x, y = q[r[some], :n], v[c[some], :n]
            if cosine:
                scale = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
                found = np.divide((x * y).sum(1), scale, out=np.zeros(len(x)), where=scale > 0)
            else:
                far = ((y - x) ** 2).sum(1)
                found = 1.0 / (1.0 + (far if squared else np.sqrt(far)))
            score[i + some] = found
    by = np.lexsort((order[at], -score, row))
    begin = np.searchsorted(row[by], np.arange(len(q)))
    kept = by[np.arange(len(by)) - begin[row[by]] < k]
    return pa.record_batch([asked.column("qid").take(pa.array(row[kept])), ids.take(pa.array(used[at[kept]])), pa.array(score[kept])], names=["qid", "id", "score"])


def _scored(parts: Parts, pairs: DataFrame, queries: int, squared: bool) -> DataFrame:
    """Scores (qid, id, score) of the k best of each part's opened blocks: ``pairs(qid, vector, kth, part, blocks)`` of a number of queries."""
    spark = pairs.sparkSession
    shares = max(1, math.ceil(queries / QUERIES_A_TASK))
    kinds = {"qid": pairs.schema["qid"].dataType.simpleString(), "id": parts.blocks.schema["ids"].dataType.elementType.simpleString()}
    none = lambda kind: F.lit(None).cast(kind)
    rows = parts.blocks.select("part", "at", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("vectors").alias("vector"))))
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    own = rows.select("part", every.alias("share"), F.lit(0).alias("what"), F.col("at").alias("lead"), "id", F.col("vector").cast("array<double>").alias("vector"), none(kinds["qid"]).alias("qid"), none("double").alias("kth"), none("array<int>").alias("blocks"))
    asked = pairs.select("part", F.pmod(F.xxhash64("qid"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("what"), F.element_at("blocks", 1).alias("lead"), none(kinds["id"]).alias("id"), "vector", "qid", "kth", "blocks")
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    met = own.unionByName(asked).repartition(count, "part", "share").sortWithinPartitions("part", "share", "what", "lead")
    return met.mapInArrow(_met(parts.rings, squared), f"qid {kinds['qid']}, id {kinds['id']}, score double")


def _rounds(parts: Parts, queries: DataFrame, squared: bool) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(scores of the first round, pairs (qid, vector, kth, part, blocks) of the first round and of the second, number of queries)."""
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    rows = f"qid {asked.schema['qid'].dataType.simpleString()}, vector array<double>, kth double, part int, blocks array<int>"
    count = asked.count()
    first = asked.mapInArrow(_sent(parts.rings, squared, True), rows)
    begun = stage(_scored(parts, first, count, squared), "vector-begun")
    order = Window.partitionBy("qid").orderBy(F.desc("score"))
    kth = begun.withColumn("r", F.row_number().over(order)).where(F.col("r") == parts.rings.k).select("qid", F.col("score").alias("kth"))
    later = asked.join(kth, "qid", "left").select("qid", "vector", "kth").mapInArrow(_sent(parts.rings, squared, False), rows)
    return begun, first, later, count


def opened(parts: Parts, queries: DataFrame, squared: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores of the first round, (qid, block) of what it opens, those of the second)."""
    begun, first, later, _ = _rounds(parts, queries, squared)
    visits = lambda pairs: pairs.select("qid", F.explode("blocks").alias("block"))
    return begun, visits(first), visits(later)


def search(parts: Parts, queries: DataFrame, squared: bool = True) -> DataFrame:
    """Nearest neighbours of ``queries(qid, vector)``: rows (qid, id, score, rank), best first, ties by id. A qid names one query."""
    begun, _, later, count = _rounds(parts, queries, squared)
    every = begun.unionByName(_scored(parts, later, count, squared))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= parts.rings.k)


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", squared: bool = True) -> DataFrame:
    return search(build(vectors, k, metric), queries, squared)
