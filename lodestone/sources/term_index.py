"""A stored inverted index: postings by term in segments, searched by blocks with score bounds.

A segment is a Parquet table in folders by a hash of the term. Its rows are blocks: for a term, a source and a run of at
most ``BLOCK`` documents of that source the ids, counts and lengths, and, beside them, how many there
are, the largest count and the least length. The empty term has every document, so numbers and lengths
of the corpus come from stored rows. A search reads no text: it reads the heads of its terms' blocks,
bounds each run of documents for each question, scores the best bounded runs, and then those others
whose bound reaches the k-th score so far; the rest of the postings is skipped.

Sources change by segments: new postings are added and the source's older ones are dead from
then on, so nothing else is rewritten. ``compact`` writes the living ones into one segment, and an
index of more than ``MOST_DEAD`` dead sources or ``MOST_SEGMENTS`` segments compacts itself.

Scale: what a search broadcasts is bounded by ``MOST_DEAD`` (the dead sources); terms meet postings in
joins that adaptive execution plans by size. A source of any share of all documents is many runs; runs are made
and written where the documents lie, so a new segment shuffles nothing, unless a task has few documents of each source.

Defined cases: null and empty texts have no terms and count with length 0; null sources are one source
of their own, the empty name; an id names one document, so rows that share one are not kept apart; a question
without terms finds nothing; ties go by id; an index without a segment is a KeyError.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import retrieval
from lodestone.sources.staging import stage
from lodestone.sources.states import States

BLOCK, LEAST_RUN = 1024, 256
QUESTIONS = 4096
FIRST = 4
MOST_DEAD, MOST_SEGMENTS = 1000, 32
FEW_TERMS = 2000
TERM_BUCKETS = 16
_KEY = ["source", "segment", "block"]


@dataclass(frozen=True)
class Ranking:
    """BM25: what weight a term of ``df`` among ``n`` documents has, k1 and b."""

    idf: Callable[[Column, Column], Column]
    k1: float
    b: float = 0.75

    def part(self, tf: Column, dl: Column, mean: float) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / F.lit(mean if mean > 0 else 1.0)))


#: The full-text index's ranking and the pool's (fixed values).
FULL_TEXT = Ranking(lambda n, df: F.greatest(F.lit(1e-6), F.log((n - df + 0.5) / (df + 0.5))), 1.2)
POOL = Ranking(lambda n, df: F.log(1 + (n - df + 0.5) / (df + 0.5)), 1.5)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def _opened() -> Column:
    """A row (id, tf, dl) for each document of a block."""
    return F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, source, terms) by source to blocks of at most ``BLOCK`` of one source: a row for each of their terms."""
    base, made = TaskContext.get().partitionId() << 32, 0
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        nonlocal made
        t = pa.Table.from_batches(held).combine_chunks()
        ids, lists = (t.column(c).combine_chunks() for c in ("id", "terms"))
        dl = np.asarray(lists.value_lengths(), np.int64)
        n = len(dl)
        coded = lists.flatten().dictionary_encode()
        pair, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), dl), return_counts=True)
        term, doc = pair // n, pair % n
        at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        names = pa.concat_arrays([coded.dictionary.take(pa.array(term[at])).cast(pa.string()), pa.array([""], pa.string())])
        doc, tf = np.concatenate([doc, np.arange(n)]), np.concatenate([tf, np.ones(n, np.int64)])
        at = np.append(at, len(term))  # and, as a last list, all documents
        offsets = np.append(at, len(doc))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (ids.take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(dl[doc], pa.int32()))]
        columns = [
            names, pa.array([held[0].column("source")[0].as_py()] * len(at), pa.string()), pa.array(np.full(len(at), base + made)), pa.array(np.diff(offsets)),
            pa.array(np.maximum.reduceat(tf, at), pa.int32()), pa.array(np.minimum.reduceat(dl[doc], at), pa.int32()), pa.array(np.add.reduceat(dl[doc], at)), *lists,
        ]
        made += 1
        held.clear()
        return pa.record_batch(columns, names=["term", "source", "block", "n", "most", "least", "total", "ids", "tfs", "dls"])

    for b in batches:
        source = b.column("source").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(source[1:] != source[:-1]) + 1).tolist(), b.num_rows]
        for a, z in itertools.pairwise(cuts):
            while a < z:
                if held and (held[0].column("source")[0].as_py() != source[a] or sum(x.num_rows for x in held) >= BLOCK):
                    yield block()
                take = min(z - a, BLOCK - sum(x.num_rows for x in held))
                held.append(b.slice(a, take))
                a += take
    if held:
        yield block()


class TermIndex:
    """An index below ``root`` of ``documents(id, source_hash, text)`` by the terms that ``terms`` makes of a text."""

    def __init__(self, spark: SparkSession, root: str, terms: Callable[[Column], Column] = tx.terms, keep: int = 3):
        self.spark, self.terms, self.keep, self.states = spark, terms, keep, States(spark, root)
        self.root = self.states.root

    # --- changing

    def _written(self, docs: DataFrame) -> str:
        """A new segment of documents; its name.

        Runs are made where the documents lie, and each task writes its own blocks, so neither texts nor postings shuffle. Only where
        sources are so many that a task has few documents of each do documents meet by source first."""
        given = docs.select("id", F.coalesce(F.col("source_hash").cast("string"), F.lit("")).alias("source"), "text")
        if self._scattered(given):
            given = given.repartitionByRange(self._parts(), "source", "id")
        near = given.sortWithinPartitions("source", "id")
        kind = docs.schema["id"].dataType.simpleString()
        words = near.select("id", "source", self.terms(F.col("text")).alias("terms"))
        blocks = words.mapInArrow(_blocks, f"term string, source string, block long, n long, most int, least int, total long, ids array<{kind}>, tfs array<int>, dls array<int>")
        return self._laid_out(blocks)

    @staticmethod
    def _scattered(given: DataFrame) -> bool:
        """Whether runs made where documents lie would be mostly short, and fewer once documents meet by source."""
        tasks = given.select("source", F.spark_partition_id().alias("task")).groupBy("source", "task").agg(F.count(F.lit(1)).alias("n"))
        runs = F.ceil(F.col("n") / BLOCK)
        each = tasks.groupBy("source").agg(F.sum(runs).alias("here"), F.ceil(F.sum("n") / BLOCK).alias("met"), F.sum("n").alias("n"))
        here, met, rows = each.agg(F.sum("here"), F.sum("met"), F.sum("n")).first()
        return rows is not None and here > 2 * met and rows < here * LEAST_RUN

    def _laid_out(self, blocks: DataFrame) -> str:
        """Blocks as a segment: folders by a hash of the term, a file of each from a task, sorted by term."""
        name = f"segments/{uuid.uuid4().hex}"
        placed = blocks.withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "source", "block")
        placed.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{self.root}/{name}")
        return name

    def _change(self, make: Callable[[dict], dict]) -> str:
        def fresh(state: dict | None) -> dict:
            return make(state or {"segments": [], "dead": {}, "next": 0})

        done = self.states.change(fresh)
        self.states.drop_old(self.keep, lambda s: {x["name"] for x in s["segments"]})
        return done

    def build(self, docs: DataFrame) -> str:
        """The whole index anew."""
        name = self._written(docs)
        return self._change(lambda s: {"segments": [{"name": name, "at": s["next"]}], "dead": {}, "next": s["next"] + 1})

    def append(self, docs: DataFrame) -> str:
        name = self._written(docs)
        return self._change(lambda s: {"segments": [*s["segments"], {"name": name, "at": s["next"]}], "dead": s["dead"], "next": s["next"] + 1})

    def replace_sources(self, docs: DataFrame) -> str:
        """The sources of some documents replaced by them: their postings only are written."""
        names = [r[0] for r in docs.select(F.coalesce(F.col("source_hash").cast("string"), F.lit(""))).distinct().collect()]  # sources named by the caller
        name = self._written(docs)
        done = self._change(lambda s: {"segments": [*s["segments"], {"name": name, "at": s["next"]}], "dead": s["dead"] | dict.fromkeys(names, s["next"]), "next": s["next"] + 1})
        return self._kept_small() or done

    def delete_sources(self, names: list[str]) -> str:
        done = self._change(lambda s: s | {"dead": s["dead"] | dict.fromkeys(names, s["next"])})
        return self._kept_small() or done

    def _kept_small(self) -> str | None:
        state = self._state()
        return self.compact() if len(state["dead"]) > MOST_DEAD or len(state["segments"]) > MOST_SEGMENTS else None

    def compact(self) -> str:
        """All living postings in one segment."""

        def make(state: dict) -> dict:
            spread = self._postings(state).withColumn("block", F.shiftleft(F.col("segment"), 52).bitwiseXOR(F.col("block"))).drop("segment", "bucket")
            name = self._laid_out(spread.repartition(F.expr(f"pmod(xxhash64(term), {TERM_BUCKETS})"), F.expr("shiftright(block, 36)")))
            return {"segments": [{"name": name, "at": state["next"]}], "dead": {}, "next": state["next"] + 1}

        return self._change(make)

    # --- reading

    def _state(self) -> dict:
        name = self.states.current()
        if name is None:
            raise KeyError("the index is empty")
        return self.states.read(name)

    def exists(self) -> bool:
        return self.states.current() is not None

    def _schema(self, state: dict):
        """Columns of the segments, read from the first that has files; a segment without documents has none."""
        from pyspark.sql.types import IntegerType, StructType

        for s in state["segments"]:
            try:
                found = self.spark.read.parquet(f"{self.root}/{s['name']}").schema
            except AnalysisException:  # no file to take columns from
                continue
            return StructType([f if f.name != "bucket" else f.__class__("bucket", IntegerType()) for f in found])
        return "term string, source string, block long, n long, most int, least int, total long, ids array<bigint>, tfs array<int>, dls array<int>, bucket int"

    def _postings(self, state: dict) -> DataFrame:
        """The living blocks of all segments, with the segment's number."""
        parts = [self.spark.read.schema(self._schema(state)).parquet(f"{self.root}/{s['name']}").withColumn("segment", F.lit(s["at"]).cast("long")) for s in state["segments"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if not state["dead"]:
            return out
        dead = self.spark.createDataFrame(list(state["dead"].items()), "source string, __until long")  # MOST_DEAD at most
        return out.join(F.broadcast(dead), "source", "left").where("__until IS NULL OR segment >= __until").drop("__until")

    def _of_terms(self, asked: DataFrame) -> tuple[DataFrame, int, float]:
        """Blocks of the asked terms, number of documents, mean length. Few terms go into the scan's filter."""
        every = self._postings(self._state())
        n, total = every.where((F.col("bucket") == _bucket(F.lit(""))) & (F.col("term") == "")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        few = [r[0] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
        if len(few) <= FEW_TERMS:
            buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in few], "term string").select(_bucket(F.col("term"))).distinct().collect()]
            found = every.where(F.col("bucket").isin(buckets) & F.col("term").isin(few))
        else:
            found = every.join(asked.select("term").distinct(), "term", "left_semi")
        return found.where("term <> ''"), n, total / n if n else 0.0

    def asked(self, questions: DataFrame, most: int | None = None) -> DataFrame:
        """Distinct terms (qid, term) of ``questions(qid, question)``, of each the first ``most``."""
        words = self.terms(F.col("question"))
        return questions.select("qid", F.explode(F.array_distinct(F.slice(words, 1, most) if most else words)).alias("term"))

    def matches(self, questions: DataFrame) -> retrieval.Matches:
        """All postings of the questions' terms, for ``retrieval.bm25_of`` and ``overlaps_of``."""
        asked = self.asked(questions)
        found, n, mean = self._of_terms(asked)
        df = found.groupBy("term").agg(F.sum("n").alias("df"))
        runs = found.select("term", *_KEY, "ids", "tfs", "dls").repartition(self._parts(), *_KEY)  # so that what is summed for a document is summed in its run's task
        hits = runs.select("term", _opened()).join(asked, "term").select("qid", "id", "term", "dl")
        return retrieval.Matches(hits, df, n, mean)

    def _bounded(self, questions: DataFrame, ranking: Ranking, most: int | None) -> tuple[DataFrame, DataFrame, DataFrame, float]:
        """(asked terms with weights, blocks of these terms, bounds (qid, key, bound), mean length)."""
        asked = self.asked(questions, most)
        found, n, mean = self._of_terms(asked)
        heads = stage(found.select("term", *_KEY, "n", "most", "least"), "term-heads")
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        weighted = stage(asked.join(df, "term").select("qid", "term", ranking.idf(F.lit(n), F.col("df")).alias("idf")), "term-weights")
        bound = F.col("idf") * ranking.part(F.col("most"), F.col("least"), mean)
        bounds = weighted.join(heads, "term").groupBy("qid", *_KEY).agg(F.sum(bound).alias("bound"))
        return weighted, found, stage(bounds, "term-bounds"), mean

    def _scored(self, pairs: DataFrame, weighted: DataFrame, found: DataFrame, ranking: Ranking, mean: float) -> DataFrame:
        """Scores (qid, id, score) of the documents of some runs; only these runs' blocks are opened."""
        wanted = pairs.select("qid", *_KEY).join(weighted, "qid")
        groups = max(1, -(-weighted.select("qid").distinct().count() // QUESTIONS))
        group = F.pmod(F.xxhash64("qid"), F.lit(groups))
        lists = wanted.groupBy("term", *_KEY, group.alias("group")).agg(F.collect_list(F.struct("qid", "idf")).alias("asked"))
        # a run's blocks meet as arrays, so that its documents' scores are summed before they shuffle
        runs = found.join(lists, ["term", *_KEY]).repartition(self._parts(), *_KEY, "group")
        part = F.col("idf") * ranking.part(F.col("tf"), F.col("dl"), mean)
        each = runs.select("asked", _opened()).select("id", "tf", "dl", F.inline("asked"))
        return each.groupBy("qid", "id").agg(F.sum(part).alias("score"))

    def _parts(self) -> int:
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def _visits(self, questions: DataFrame, k: int, ranking: Ranking, most: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(scores of the first runs, bounds, bounds of the runs that must be visited after them)."""
        weighted, found, bounds, mean = self._bounded(questions, ranking, most)
        best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), *_KEY))
        placed = stage(bounds.withColumn("place", best), "term-bounds")
        first = stage(self._scored(placed.where(F.col("place") <= FIRST), weighted, found, ranking, mean), "term-first")
        kth = first.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("r") == k).select("qid", F.col("score").alias("kth"))
        # ranks go by scores of 9 places, so runs a rounding below the k-th score are opened too
        later = placed.where(F.col("place") > FIRST).join(kth, "qid", "left").where("kth IS NULL OR bound >= kth - 1e-8")
        return first.unionByName(self._scored(later, weighted, found, ranking, mean)), bounds, later

    def search(self, questions: DataFrame, k: int, ranking: Ranking = FULL_TEXT, most: int | None = None) -> DataFrame:
        """The k best documents of each question: (qid, id, score, rank)."""
        scored, _, _ = self._visits(questions, k, ranking, most)
        order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def coverage(self, questions: DataFrame, k: int, ranking: Ranking = FULL_TEXT, most: int | None = None) -> tuple[int, int]:
        """Runs of documents that hold a term of a question, and how many of them a search opens."""
        _, bounds, later = self._visits(questions, k, ranking, most)
        first = bounds.groupBy("qid").agg(F.least(F.count(F.lit(1)), F.lit(FIRST)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return bounds.count(), first + later.count()
