"""Approximate nearest neighbours: an inverted file over k-means centroids.

The vectors are stored in folders by list, so a search of few queries reads the lists of the
nearest centroids only, and ranks them exactly. Small
tables need no index (``wanted``), and an index is built anew once enough of it has changed (``stale``).
A search deals the probed lists out as parts of about ``PART_ROWS`` vectors, several lists or a share of one,
and a query travels once to each part that holds one of its lists: no row is made of a query and a vector.
Beside the lists there are codes: a vector's place in each of ``PARTS`` sub-spaces as one byte,
so that a search reads 16 bytes in place of 256 for vectors of 64 numbers, scores by table lookup, and
ranks the ``REFINE * k`` best of each query exactly (``coded``, ``search_coded``). Codes are small, so they travel to groups
of about ``QUERIES_A_TASK`` queries; a task keeps the best of each query while codes pass, and gives no row for a query and a list.

Defined cases: null vectors are in no list and find nothing; all vectors have one length; ties go by
id; an empty table has no lists.

The number of probed lists is measured: a sample of the queries is answered exactly, and as many
lists are probed as hold ``RECALL`` of those neighbours, never fewer than ``PROBES``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.sources.staging import stage

LEAST_ROWS, MOST_LISTS, PROBES = 50_000, 1024, 50
SAMPLE, MEASURED, RECALL = 20_000, 256, 0.9
PARTS, REFINE, CODED_BLOCK = 16, 20, 4096
PART_ROWS, TOGETHER = 16_384, 128
QUERIES_A_TASK, SHARES, CODES_A_TASK, HELD = 1024, 4, 1 << 20, 1 << 20


def stale(changed: int, total: int, share: float = 0.01) -> bool:
    """Whether so many rows have changed since the index was built that it is to be built anew."""
    return total > 0 and changed / total >= share


@dataclass
class Index:
    """Vectors with their list, and the centroids (at most ``MOST_LISTS``)."""

    lists: DataFrame
    centroids: np.ndarray


def wanted(rows: int) -> bool:
    return rows >= LEAST_ROWS


def centroids_of(vectors: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means on a bounded sample."""
    g = np.random.default_rng(seed)
    c = vectors[g.choice(len(vectors), min(lists, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(vectors, c, 1)[:, 0]
        for i in range(len(c)):
            if (near == i).any():
                c[i] = vectors[near == i].mean(0)
    return c


def _nearest(v: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    distance = (c * c).sum(1)[None] - 2 * v @ c.T
    if n == 1 and len(c):
        return np.argmin(distance, axis=1)[:, None]
    return np.argsort(distance, axis=1, kind="stable")[:, :n]


def sample_of(rows: DataFrame, by: list[str], n: int) -> list[list[float]]:
    """Vectors of the ``SAMPLE`` rows of least hashes of ``by`` among ``n`` rows.

    Each task gives the driver as many as are wanted in all, so rows of hashes above those of the least ``2 * SAMPLE``,
    as far as hashes are even, are left out before.
    """
    key = F.xxhash64(*by)
    least = lambda df: [r[0] for r in df.orderBy(key).limit(SAMPLE).select("vector").collect()]
    if n <= 2 * SAMPLE:
        return least(rows)
    found = least(rows.where(key <= F.lit(int(2**64 * (2 * SAMPLE / n)) - 2**63)))
    return found if len(found) == SAMPLE else least(rows)  # where many rows share a hash


def present(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds an index."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/centroids/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save(index: Index, folder: str) -> None:
    """Store the lists, a folder each, and then the centroids, which make the index complete."""
    spark = index.lists.sparkSession
    drop(spark, folder)
    index.lists.repartition("list").write.partitionBy("list").parquet(f"{folder}/lists")
    rows = [(i, c.tolist()) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")


def load(spark: SparkSession, folder: str) -> Index:
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()  # at most ``MOST_LISTS``
    lists = spark.read.parquet(f"{folder}/lists").select("id", "vector", "list")
    return Index(lists, np.array([r.centroid for r in rows], np.float64))


def build(vectors: DataFrame, lists: int | None = None) -> Index:
    """An index of all vectors of one length; null ones are left out. The centroids come from a sample of at most ``SAMPLE`` rows."""
    vectors = vectors.where("vector IS NOT NULL")
    rows = vectors.count()
    lists = lists or max(1, min(MOST_LISTS, math.isqrt(rows)))
    some = sample_of(vectors, ["id"], rows)
    centroids = centroids_of(np.array(some, np.float64), lists) if some else np.empty((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.stack([np.asarray(x, np.float64) for x in b.column(1).to_numpy(zero_copy_only=False)]) if b.num_rows else np.empty((0, 1))
            near = _nearest(v, centroids, 1)[:, 0] if b.num_rows else np.empty(0, np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(near, pa.int32())], names=["id", "vector", "list"])

    schema = f"id {vectors.schema['id'].dataType.simpleString()}, vector array<float>, list int"
    return Index(vectors.select("id", F.col("vector").cast("array<float>")).mapInArrow(assign, schema), centroids)


def probes_for(index: Index, queries: DataFrame, k: int, least: int = PROBES, recall: float = RECALL) -> int:
    """The least number of lists, from ``least`` on, that keeps ``recall`` of the exact neighbours.

    Measured on at most ``MEASURED`` queries, spread by another hash than the vectors on which the centroids are fitted,
    whose neighbours lie in fewer lists; three standard errors of the mean stand against the error of the sample.
    """
    c = index.centroids
    if len(c) <= least:
        return least
    some = queries.select("qid", "vector").where(F.col("vector").isNotNull()).orderBy(F.xxhash64(F.lit("measured"), "qid"), "qid").limit(MEASURED)
    asked = some.collect()
    if not asked:
        return least
    exact = retrieval.knn(index.lists, queries.sparkSession.createDataFrame(asked, some.schema), k).select("qid", "id")
    near = index.lists.select("id", "list").join(F.broadcast(exact), "id").select("qid", "list").collect()  # MEASURED * k rows
    order = np.argsort(_nearest(np.array([r.vector for r in asked], np.float64), c, len(c)), axis=1)
    row = {r.qid: i for i, r in enumerate(asked)}
    at = np.array([row[r.qid] for r in near], np.int64)
    place = order[at, [r.list for r in near]]  # how many lists are nearer than the neighbour's
    each = np.bincount(at, minlength=len(asked))
    for probes in range(least, len(c)):
        share = np.bincount(at[place < probes], minlength=len(asked)) / np.maximum(each, 1)
        if share.mean() - 3 * share.std() / math.sqrt(len(share)) >= recall:
            return probes
    return len(c)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """Nearest neighbours within the probed lists, as many as ``probes_for`` says unless given: rows (qid, id, score, rank)."""
    probes = probes or probes_for(index, queries, k)
    c = index.centroids
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL" if len(c) else "false")
    kinds = {"qid": asked.schema["qid"].dataType.simpleString(), "id": index.lists.schema["id"].dataType.simpleString()}

    def probed(v: pa.Array) -> np.ndarray:
        return _nearest(np.stack(v.to_numpy(zero_copy_only=False)).astype(np.float64), c, probes)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.unique(probed(b.column(0))) for b in batches if b.num_rows]
        yield pa.record_batch([pa.array(np.unique(np.concatenate(seen)) if seen else [], pa.int32())], names=["list"])

    some = [r[0] for r in asked.select("vector").mapInArrow(opened, "list int").distinct().collect()]  # at most ``MOST_LISTS``
    lists = index.lists.where(F.col("list").isin(some))
    sizes = np.zeros(len(c), np.int64)
    for r in lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each list
        sizes[r["list"]] = r["n"]
    shares = np.maximum(1, -(-sizes // PART_ROWS))
    first, last, held = np.zeros(len(c), np.int64), -1, PART_ROWS + 1
    for i, n in enumerate(sizes):
        if held + n > PART_ROWS:
            last, held = last + 1, 0
        first[i], held = last, held + n
        last += int(shares[i]) - 1

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = probed(b.column(1))
            row = np.repeat(np.arange(len(near)), near.shape[1])
            count = shares[near.ravel()]
            at = first[near.ravel()].repeat(count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            each = np.unique(np.stack([row.repeat(count), at, near.ravel().repeat(count)]), axis=1)  # by query and part
            cut = np.flatnonzero(np.concatenate([[True], (each[:2, 1:] != each[:2, :-1]).any(axis=0)]))
            own = pa.ListArray.from_arrays(pa.array(np.append(cut, each.shape[1]), pa.int32()), pa.array(each[2], pa.int32()))
            took = pa.array(each[0, cut])
            yield pa.record_batch([b.column(0).take(took), b.column(1).take(took), pa.array(each[1, cut], pa.int32()), own], names=["qid", "vector", "part", "lists"])

    none = lambda kind: F.lit(None).cast(kind)
    places = queries.sparkSession.createDataFrame([(i, int(first[i]), int(shares[i])) for i in some], "list int, first int, shares int")
    part = F.col("first") + F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")
    vectors = lists.join(F.broadcast(places), "list").select(part.alias("part"), F.lit(0).alias("what"), F.array("list").alias("lists"), F.col("vector").cast("array<double>").alias("vector"), "id", none(kinds["qid"]).alias("qid"))
    pairs = asked.mapInArrow(sent, f"qid {kinds['qid']}, vector array<double>, part int, lists array<int>").select("part", F.lit(1).alias("what"), "lists", "vector", none(kinds["id"]).alias("id"), "qid")
    parts = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    met = vectors.unionByName(pairs).repartition(parts, "part").sortWithinPartitions("part", "what")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    found = met.mapInArrow(_met(len(c), k), f"qid {kinds['qid']}, id {kinds['id']}, score double")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _met(lists: int, k: int):
    """Parts of vectors, each before the queries that open it, to the k best of each query's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, ready = None, [], None
        for b in batches:
            key = b.column("part").to_numpy() * 2 + b.column("what").to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if not len(key):
                    continue
                if key[a] // 2 != part:
                    part, waiting, ready = key[a] // 2, [], None
                if key[a] % 2 == 0:
                    few = b.slice(a, z - a)
                    waiting.append((few.column("id"), few.column("lists").flatten().to_numpy(), np.stack(few.column("vector").to_numpy(zero_copy_only=False))))
                    continue
                if ready is None and waiting:
                    ids = pa.concat_arrays([x[0] for x in waiting])
                    ready = (ids, retrieval._rank(ids), *(np.concatenate([x[i] for x in waiting]) for i in (1, 2)))
                    waiting = []
                for i in range(a, z if ready else a, TOGETHER):
                    yield _within(b.slice(i, min(TOGETHER, z - i)), *ready, lists, k)

    return run


def _within(asked: pa.RecordBatch, ids: pa.Array, order: np.ndarray, own: np.ndarray, v: np.ndarray, lists: int, k: int) -> pa.RecordBatch:
    """The k best of some queries among the vectors of their lists. Matrix products only choose; scores come from differences."""
    q = np.stack(asked.column("vector").to_numpy(zero_copy_only=False))
    opens = np.zeros((len(q), lists), bool)
    opens[np.repeat(np.arange(len(q)), asked.column("lists").value_lengths().to_numpy()), asked.column("lists").flatten().to_numpy()] = True
    square = (q * q).sum(1)[:, None] + (v * v).sum(1)[None]
    near = 1 / (1 + np.maximum(square - 2 * q @ v.T, 0))
    near[~opens[:, own]] = -1
    kth = -np.partition(-near, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1]
    row, at = np.nonzero((near >= kth[:, None] - 2e-6) & (near >= 0))
    far = np.concatenate([((q[row[i : i + 65536]] - v[at[i : i + 65536]]) ** 2).sum(1) for i in range(0, max(1, len(row)), 65536)])
    score = np.round(1 / (1 + far), 6)
    by = np.lexsort((order[at], -score, row))
    begin = np.searchsorted(row[by], np.arange(len(q)))
    kept = by[np.arange(len(by)) - begin[row[by]] < k]
    return pa.record_batch([asked.column("qid").take(pa.array(row[kept])), ids.take(pa.array(at[kept])), pa.array(score[kept])], names=["qid", "id", "score"])


@dataclass
class Codebooks:
    """Centroids of the lists and, for each sub-space, of its numbers: (parts, 256 at most, numbers)."""

    centroids: np.ndarray
    books: np.ndarray

    def codes(self, v: np.ndarray) -> np.ndarray:
        sub = self.books.shape[2]
        return np.stack([_nearest(v[:, j * sub : (j + 1) * sub], b, 1)[:, 0] for j, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of some queries to the rows of each codebook: (parts, 256, queries)."""
        sub = self.books.shape[2]
        return np.stack([((q[:, None, j * sub : (j + 1) * sub] - book[None]) ** 2).sum(2).T for j, book in enumerate(self.books)])


@dataclass
class Coded:
    """Blocks (block, list, n, ids, codes) of at most ``CODED_BLOCK`` coded vectors of one list, and the index that they code."""

    blocks: DataFrame
    index: Index
    books: Codebooks


def coded(index: Index, parts: int = PARTS) -> Coded:
    """Codes of all vectors of an index. Codebooks come from a sample of at most ``SAMPLE`` vectors.

    The number of parts is lowered to the next one that divides the vectors' length.
    """
    some = sample_of(index.lists, ["id"], index.lists.count())
    kind = index.lists.schema["id"].dataType.simpleString()
    schema = f"block long, list int, n int, ids array<{kind}>, codes binary"
    if not some:
        return Coded(index.lists.sparkSession.createDataFrame([], schema), index, Codebooks(index.centroids, np.empty((0, 0, 0))))
    sample = np.array(some, np.float64)
    parts = next(p for p in range(min(parts, sample.shape[1]), 0, -1) if sample.shape[1] % p == 0)
    books = np.stack([_filled(centroids_of(x, 256)) for x in np.split(sample, parts, axis=1)])
    made = Codebooks(index.centroids, books)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            lists = b.column("list").to_numpy()
            cuts = np.flatnonzero(lists[1:] != lists[:-1]) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lists)], strict=True):
                for k in range(a, z, CODED_BLOCK):
                    few = b.slice(k, min(CODED_BLOCK, z - k))
                    v = np.stack(few.column("vector").to_numpy(zero_copy_only=False)).astype(np.float64)
                    ids = pa.ListArray.from_arrays(pa.array([0, few.num_rows], pa.int32()), few.column("id"))
                    yield pa.record_batch([pa.array([base + count]), pa.array([lists[a]], pa.int32()), pa.array([few.num_rows], pa.int32()), ids, pa.array([made.codes(v).tobytes()], pa.binary())], names=["block", "list", "n", "ids", "codes"])
                    count += 1

    count = max(1, int(index.lists.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = index.lists.repartitionByRange(count, "list", "id").sortWithinPartitions("list", "id")
    return Coded(stage(dealt.mapInArrow(packed, schema), "vector-codes"), index, made)


def _filled(book: np.ndarray) -> np.ndarray:
    """A codebook of 256 rows; those that few vectors leave over repeat the first."""
    return np.concatenate([book, np.repeat(book[:1], 256 - len(book), axis=0)])


def search_coded(table: Coded, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """Nearest neighbours by codes within the probed lists, the best ``REFINE * k`` ranked exactly: rows (qid, id, score, rank).

    Without ``probes`` as many lists are probed as hold 0.95 of a sample's exact neighbours, which leaves
    room for what the codes lose. A group of queries meets all codes, in ``SHARES`` tasks or more, each with a query once and
    ``CODES_A_TASK`` codes or so at most.
    """
    probes = probes or probes_for(table.index, queries, k, 1, 0.95)
    books, parts = table.books, max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL" if len(books.books) else "false")
    met = _cells(table, asked).repartition(parts, "group", "share").sortWithinPartitions("group", "share", "what", "block")
    kinds = {c: met.schema[c].dataType.simpleString() for c in ("qid", "ids")}
    near = met.mapInArrow(_least(books, probes, REFINE * k), f"qid {kinds['qid']}, id {kinds['ids'][6:-1]}, far double")
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("far", "id"))).where(F.col("r") <= REFINE * k)
    exact = few.join(table.index.lists.select("id", "vector"), "id").join(asked.withColumnRenamed("vector", "q"), "qid")
    distance = F.aggregate(F.zip_with("q", "vector", lambda x, y: F.pow(x - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    scored_rows = exact.select("qid", "id", F.round(1 / (1 + distance), 6).alias("score"))
    return scored_rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _cells(table: Coded, asked: DataFrame) -> DataFrame:
    """Queries and blocks of codes by group of queries and share of the codes: a query is there once for a share, a block once for a group."""
    groups = max(1, -(-asked.count() // QUERIES_A_TASK))
    codes = table.blocks.agg(F.sum("n")).first()[0] or 0
    shares = max(SHARES, -(-codes // CODES_A_TASK))
    none = lambda kind: F.lit(None).cast(kind)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    blocks = table.blocks
    sent = asked.select(dealt("qid", groups).alias("group"), every(shares).alias("share"), F.lit(0).alias("what"), none("long").alias("block"), none("int").alias("list"), none(blocks.schema["ids"].dataType).alias("ids"), none("binary").alias("codes"), "qid", "vector")
    own = blocks.select(every(groups).alias("group"), dealt("block", shares).alias("share"), F.lit(1).alias("what"), "block", "list", "ids", "codes", none(asked.schema["qid"].dataType).alias("qid"), none("array<double>").alias("vector"))
    return sent.unionByName(own)


def _least(books: Codebooks, probes: int, few: int):
    """Groups of queries, each before the codes that it meets, to the ``few`` nearest codes of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, group = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("group", "share", "what")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, z in itertools.pairwise([0, *cuts.tolist(), b.num_rows] if b.num_rows else []):
                if tuple(keys[:2, a]) != cell:
                    if group:
                        yield from group.best()
                    cell, waiting, group = tuple(keys[:2, a]), [], None
                if keys[2, a] == 0:
                    waiting.append(b.slice(a, z - a))
                    continue
                if waiting:
                    group, waiting = _Group(books, waiting, probes, few), []
                for i in range(a, z if group else a):
                    codes = np.frombuffer(b.column("codes")[i].as_py(), np.uint8).reshape(-1, len(books.books))
                    group.meet(b.column("list")[i].as_py(), b.column("ids")[i].values, codes)
        if group:
            yield from group.best()

    return run


class _Group:
    """Some queries and, of the codes that they have met, the ``few`` nearest to each, equal distances by id."""

    def __init__(self, books: Codebooks, asked: list[pa.RecordBatch], probes: int, few: int):
        self.qids = pa.concat_arrays([b.column("qid") for b in asked])
        q = np.concatenate([np.stack(b.column("vector").to_numpy(zero_copy_only=False)) for b in asked])
        self.opens = np.zeros((len(q), len(books.centroids)), bool)
        np.put_along_axis(self.opens, _nearest(q, books.centroids, probes), True, axis=1)
        self.tables = [np.ascontiguousarray(books.tables(q[i : i + TOGETHER])) for i in range(0, len(q), TOGETHER)]
        self.few, self.limit = few, np.full(len(q), np.inf)
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.rows = 0

    def meet(self, own: int, ids: pa.Array, codes: np.ndarray) -> None:
        """A block of codes of a list; only the queries that open the list take some."""
        for i, table in enumerate(self.tables):
            row = np.flatnonzero(self.opens[i * TOGETHER : (i + 1) * TOGETHER, own])
            if not len(row):
                continue
            most = 2 * len(row) >= table.shape[2]
            far = np.zeros((len(codes), table.shape[2] if most else len(row)))
            for part, code in zip(table if most else table[:, :, row], codes.T, strict=True):
                far += part.take(code, axis=0)
            far = far[:, row] if most and len(row) < table.shape[2] else far
            row += i * TOGETHER
            near = far <= self.limit[row]
            for c in np.flatnonzero(near.sum(axis=0) > 2 * self.few):
                near[:, c] &= far[:, c] <= np.partition(far[:, c], self.few - 1)[self.few - 1]
            at, c = np.nonzero(near)
            self.held.append((row[c], ids.take(pa.array(at)), far[at, c]))
            self.rows += len(at)
            if self.rows > max(HELD, 2 * self.few * len(self.limit)):
                self.settle()

    def settle(self) -> None:
        """Drop all but the ``few`` nearest of each query; no later code beyond the last of them is taken."""
        row, far = (np.concatenate([x[i] for x in self.held]) for i in (0, 2))
        ids = pa.concat_arrays([x[1] for x in self.held])
        by = np.lexsort((retrieval._rank(ids), far, row))
        begin = np.searchsorted(row[by], np.arange(len(self.limit)))
        kept = by[np.arange(len(by)) - begin[row[by]] < self.few]
        row, far = row[kept], far[kept]
        self.held, self.rows = [(row, ids.take(pa.array(kept)), far)], len(kept)
        full = np.bincount(row, minlength=len(self.limit)) == self.few
        self.limit[full] = far[np.searchsorted(row, np.flatnonzero(full), side="right") - 1]

    def best(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.settle()
            row, ids, far = self.held[0]
            yield pa.record_batch([self.qids.take(pa.array(row)), ids, pa.array(far)], names=["qid", "id", "far"])
