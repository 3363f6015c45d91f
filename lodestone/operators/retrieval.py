"""Retrieval: nearest neighbours, BM25, rank fusion, reliability, hybrid ranking, context budget.

All operators take any number of queries at once, keyed by ``qid``, so a batch of questions
is one job.

Defined cases: null vectors and null texts never match; ties go by id, nulls first; repeated
records count as often as they stand; empty inputs give empty results; other columns are left
alone where the docstring does not say that they are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.sources.staging import stage

K1, B = 1.5, 0.75
RRF_K = 60
LEXICAL_WEIGHT = 0.20
CANDIDATES, MIN_SCORE, RELATIVE_CUTOFF = 80, 0.50, 0.72
QUERY_BLOCK = 2048
FEW_TERMS = 100_000
#: Weight of each group of sources (fixed values).
SOURCE_WEIGHTS = {"official": 1.0, "student_research": 0.9, "unofficial": 0.8, "ungrouped": 0.1}


def distance_score(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def knn(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES, metric: str = "l2", squared: bool = True) -> DataFrame:
    """Exact nearest neighbours: rows (qid, id, score, rank), best first, ties by id.

    Up to ``QUERY_BLOCK`` queries ``(qid, vector)``, a bounded number, travel to ``vectors(id, vector)`` in
    the tasks' own code; each task keeps its own k best of each query, so what shuffles is k rows
    for each part and query. More queries meet the vectors in parts with bounds (``nearest``), so that each
    travels only to the parts that can hold a neighbour; a qid is then one query. A vector of
    another length than the query's counts over the shorter length.
    """
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    given = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    id_type, qid_type = (df.schema[c].dataType.simpleString() for df, c in ((given, "id"), (asked, "qid")))
    schema = f"qid {qid_type}, id {id_type}, score double"
    few = asked.limit(QUERY_BLOCK + 1).toArrow()
    if few.num_rows > QUERY_BLOCK:
        from lodestone.operators import nearest

        return nearest.knn(given, asked, k, metric, squared)
    found = given.mapInArrow(_near_few(few, k, metric, squared), schema)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of zeros up to the longest, and their lengths."""
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten().fill_null(0.0))
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1])[None] < size[:, None]] = flat
    return out, size


def _scores(q: np.ndarray, q_size: np.ndarray, v: np.ndarray, v_size: np.ndarray, metric: str, squared: bool) -> np.ndarray:
    """Scores of all queries against all vectors, over the shorter length of each pair."""
    out = np.empty((len(q), len(v)))
    for n in np.unique(q_size):
        own = np.flatnonzero(q_size == n)
        for m in np.unique(v_size):
            other = np.flatnonzero(v_size == m)
            a, b = q[own][:, : min(n, m)], v[other][:, : min(n, m)]
            if metric == "cosine":
                scale = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
                score = np.divide(a @ b.T, scale, out=np.zeros((len(a), len(b))), where=scale > 0)
            else:
                distance = np.stack([((b - x) ** 2).sum(1) for x in a])
                score = 1.0 / (1.0 + (distance if squared else np.sqrt(distance)))
            out[np.ix_(own, other)] = score
    return out


def _best(qids: pa.Array, ids: pa.Array, score: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each row, ties by id."""
    order = np.asarray(pc.array_sort_indices(ids, null_placement="at_start")) if len(ids) else np.empty(0, np.int64)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    top = np.lexsort((np.broadcast_to(rank, score.shape), -score), axis=1)[:, :k]
    row = np.repeat(np.arange(len(qids)), top.shape[1])
    return pa.record_batch([qids.take(pa.array(row)), ids.take(pa.array(top.ravel())), pa.array(score[row, top.ravel()])], names=["qid", "id", "score"])


def _whole(columns: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(columns)


def _near_few(queries: pa.Table, k: int, metric: str, squared: bool):
    """Tasks that hold all queries and a running choice of ids that some query has among its k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.combine_chunks()
        if not asked.num_rows:
            return
        qids = _whole(asked.column(0).chunks)
        q = _matrix(_whole(asked.column(1).chunks))
        ids, best = None, None
        for b in batches:
            if not b.num_rows:
                continue
            score = _scores(*q, *_matrix(b.column(1)), metric, squared)
            ids = b.column(0) if ids is None else _whole([ids, b.column(0)])
            best = score if best is None else np.concatenate([best, score], axis=1)
            if len(ids) > 8 * k:
                kept = np.unique(np.argpartition(-best, k - 1, axis=1)[:, :k]) if not _tied(best, k) else np.unique(np.lexsort((np.broadcast_to(_rank(ids), best.shape), -best), axis=1)[:, :k])
                ids, best = ids.take(pa.array(kept)), best[:, kept]
        if ids is not None:
            yield _best(qids, ids, best, k)

    return run


def _rank(ids: pa.Array) -> np.ndarray:
    out = np.empty(len(ids), np.int64)
    out[np.asarray(pc.array_sort_indices(ids, null_placement="at_start"))] = np.arange(len(ids))
    return out


def _tied(score: np.ndarray, k: int) -> bool:
    """Whether the k-th best score of some row stands again beyond the first k."""
    last = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    return bool(((score >= last).sum(axis=1) > k).any())


@dataclass
class Matches:
    """What BM25 and overlaps are computed from: the postings of the queries' terms, and the corpus's numbers."""

    hits: DataFrame  # qid, id, term, dl
    terms: DataFrame  # term, df
    n: int
    mean_dl: float


def with_lengths(words: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (id, dl, term) of ``words(id, dl, terms)``, staged: the asked terms that a text has, with
    repeats, and one with a null term for every text, so that numbers and lengths are counted from stored rows.

    Up to ``FEW_TERMS`` asked terms travel to the texts, so that no word shuffles; more meet the words in a join."""
    every = F.concat(F.lit("\0"), F.pmod(F.xxhash64("id"), F.lit(1024)))  # no term; spread over many keys of the join
    each = words.select("id", "dl", F.explode(F.concat(F.array(every), "terms")).alias("term"))
    wanted = stage(asked.select("term").distinct().withColumn("__wanted", F.lit(True)), "asked-terms")
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_TERMS else wanted.hint("merge")
    whole = F.col("term").startswith("\0")
    met = each.join(wanted, "term", "left").where(F.col("__wanted").isNotNull() | whole)
    return stage(met.select("id", "dl", F.when(~whole, F.col("term")).alias("term")), "postings")


def lengths_of(kept: DataFrame) -> tuple[int, float]:
    """Number and mean length of the texts behind the rows of ``with_lengths``."""
    n, total = kept.where("term IS NULL").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return n, total / n if n else 0.0


def matched(docs: DataFrame, text: Column, queries: DataFrame) -> Matches:
    """One pass over the texts of ``docs(id, ...)``: postings of the terms of ``queries(qid, question)``, staged.

    Only postings of terms that some query has leave the pass, and a row for each document, from which
    the number and mean length of all are counted. A ``TermIndex`` gives the same without a pass.
    """
    asked = queries.select("qid", F.explode(tx.keywords(F.col("question"))).alias("term"))
    kept = with_lengths(docs.select("id", tx.keywords(text).alias("terms")).withColumn("dl", F.size("terms")), asked)
    n, mean = lengths_of(kept)
    df = kept.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Matches(kept.join(asked, "term").select("qid", "id", "term", "dl"), df, n, mean)


def _bm25_weight(n: Column, df: Column, dl: Column, mean_dl: Column, k1: float, b: float) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = F.when(mean_dl <= 0, 1.0).otherwise(mean_dl)
    return idf * (k1 + 1) / (1 + k1 * (1 - b + b * dl / mean))


def bm25_of(found: Matches, k1: float = K1, b: float = B) -> DataFrame:
    """Rows (qid, id, bm25) of the documents that hold a query term."""
    weight = _bm25_weight(F.lit(found.n), F.col("df"), F.col("dl"), F.lit(float(found.mean_dl)), k1, b)
    return found.hits.join(found.terms, "term").groupBy("qid", "id").agg(F.sum(weight).alias("bm25"))


def overlaps_of(found: Matches) -> DataFrame:
    """Rows (qid, id, hits): how many distinct terms of the query a document holds."""
    return found.hits.groupBy("qid", "id").agg(F.count(F.lit(1)).alias("hits"))


def bm25(docs: DataFrame, text: Column, queries: DataFrame, k1: float = K1, b: float = B, pool: list[str] | None = None) -> DataFrame:
    """BM25 with each keyword counted once: rows (qid, id, bm25) of documents with a query keyword.

    ``queries(qid, question)``. Statistics are those of all documents, or, with ``pool`` naming
    columns of ``docs`` (such as qid), those of each pool.
    """
    if not pool:
        return bm25_of(matched(docs, text, queries), k1, b)
    words = stage(docs.select(*pool, "id", tx.keywords(text).alias("terms")).withColumn("dl", F.size("terms")), "pool-terms")
    stats = words.groupBy(*pool).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean_dl"))
    asked = queries.select("qid", F.explode(tx.keywords(F.col("question"))).alias("term"))
    key = ["qid", "term"] if "qid" in pool else ["term"]
    hits = words.select(*pool, "id", "dl", F.explode("terms").alias("term")).join(asked, key)
    df = hits.groupBy(*pool, "term").agg(F.count_distinct("id").alias("df"))
    full = hits.join(df, [*pool, "term"]).join(stats, pool)
    return full.groupBy("qid", "id").agg(F.sum(_bm25_weight(F.col("n"), F.col("df"), F.col("dl"), F.col("mean_dl"), k1, b)).alias("bm25"))


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (qid, id, rank): rows (qid, id, rrf)."""
    parts = [x.select("qid", "id", (F.lit(1.0) / (k + F.col("rank"))).alias("part")) for x in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("qid", "id").agg(F.sum("part").alias("rrf"))


def ranked(scores: DataFrame, score: str) -> DataFrame:
    """Adds ``rank`` by falling score within each query, ties by id."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "id")))


def ranked_wide(scores: DataFrame, score: str) -> DataFrame:
    """``ranked`` where a query has a share of all documents: rows are sorted by range, so that no task holds all of
    a query's, and a row's rank is its place in its task after those of the query in tasks before."""
    parts = max(1, int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    order = ["qid", F.desc(score), "id"]
    sorted_rows = scores.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its task
    placed = stage(sorted_rows.withColumns({"__task": F.spark_partition_id(), "__at": at}), "ranked")
    runs = placed.groupBy("qid", "__task").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("qid").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumnRenamed("qid", "__qid")
    joined = placed.join(offsets.withColumnRenamed("__task", "__run"), F.col("qid").eqNullSafe(F.col("__qid")) & (F.col("__task") == F.col("__run")))
    return joined.select(*scores.columns, (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias("rank"))


def source_weight(group: Column) -> Column:
    weight = F.lit(SOURCE_WEIGHTS["ungrouped"])
    for name, value in SOURCE_WEIGHTS.items():
        weight = F.when(F.lower(F.trim(group)) == name, value).otherwise(weight)
    return weight


def lexical_overlap(query_terms: Column, doc_terms: Column, title_terms: Column) -> Column:
    """Share of the query's keywords in a document, with a bonus for those in its title, 1 at most."""
    n = F.greatest(F.size(query_terms), F.lit(1))
    return F.least(F.lit(1.0), F.size(F.array_intersect(query_terms, doc_terms)) / n + 0.15 * F.size(F.array_intersect(query_terms, title_terms)) / n)


def asked_words(queries: DataFrame) -> DataFrame:
    """Rows (qid, asked) of the keywords of ``queries(qid, question)``."""
    words = queries.select("qid", tx.keywords(F.col("question")).alias("words"))
    return words.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("asked"))


def pool_scores(candidates: DataFrame, queries: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Adds to candidates (qid, id, score, content) what blending needs: rrf, the query's max_rrf and best
    score, and whether any candidate of the query has a lexical match, and drops the content. Candidates, at most some hundred
    a query, are staged without their texts, so they are found once."""
    met = candidates.join(asked_words(queries), "qid", "left")
    return pooled(met.withColumn("words", tx.keywords(F.col("content"))).drop("content"), rrf_k)


def pooled(candidates: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """``pool_scores`` for candidates (qid, id, score, asked, words): of a candidate's words their number and those that
    its query asks for go on, neither its text nor its other words."""
    candidates = stage(candidates.withColumns({"dl": F.size("words"), "hits": F.array_intersect("words", "asked")}).drop("words", "asked"), "candidates")
    stats = candidates.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean_dl"))
    held = candidates.select("qid", "id", "dl", F.explode("hits").alias("term"))
    df = held.groupBy("qid", "term").agg(F.count_distinct("id").alias("df"))
    weight = _bm25_weight(F.col("n"), F.col("df"), F.col("dl"), F.col("mean_dl"), K1, B)
    found = held.join(df, ["qid", "term"]).join(stats, "qid").groupBy("qid", "id").agg(F.sum(weight).alias("bm25"))
    lexical = stage(found.where("bm25 > 0").withColumn("bm25", F.round("bm25", 9)), "pool-lexical")
    some = lexical.select("qid").distinct().withColumn("lexical", F.lit(True))
    rrf = fuse([ranked(candidates.select("qid", "id", "score"), "score"), ranked(lexical, "bm25")], rrf_k)
    pool = Window.partitionBy("qid")
    joined = candidates.drop("dl", "hits").join(rrf, ["qid", "id"]).join(some, "qid", "left").withColumn("lexical", F.coalesce("lexical", F.lit(False)))
    return joined.withColumns({"max_rrf": F.max("rrf").over(pool), "best": F.max("score").over(pool)})


def blended(vector: Column, rrf: Column, max_rrf: Column, lexical: Column, weight: float = LEXICAL_WEIGHT) -> Column:
    """Vector score with a share of the fused rank; the vector score alone where no candidate matches a word."""
    return F.when(lexical, (1 - weight) * vector + weight * rrf / max_rrf).otherwise(vector)


def hybrid(candidates: DataFrame, queries: DataFrame, weight: float = LEXICAL_WEIGHT, rrf_k: int = RRF_K, min_score: float = MIN_SCORE, relative: float = RELATIVE_CUTOFF) -> DataFrame:
    """Hybrid ranking of nearest neighbours.

    ``candidates(qid, id, score, content, source_group)``: BM25 over each query's pool, fused
    with the vector ranking, blended into the vector score, times the source's weight; then the
    gate on the vector score. Rows (qid, id, vector_score, hybrid_score, score, rank).
    """
    return gated(pool_scores(candidates, queries, rrf_k), weight, min_score, relative)


def gated(pool: DataFrame, weight: float = LEXICAL_WEIGHT, min_score: float = MIN_SCORE, relative: float = RELATIVE_CUTOFF) -> DataFrame:
    """The ranking of ``hybrid`` from the rows of ``pool_scores``."""
    blend = blended(F.col("score"), F.col("rrf"), F.col("max_rrf"), F.col("lexical"), weight)
    scored = pool.select(
        "qid", "id", F.round("score", 4).alias("vector_score"), F.round(blend, 4).alias("hybrid_score"),
        F.round(blend * source_weight(F.col("source_group")), 4).alias("final"), F.greatest(F.lit(min_score), F.col("best") * relative).alias("cutoff"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("final"), F.desc("vector_score"), "id")
    return scored.where(F.col("vector_score") >= F.col("cutoff")).select("qid", "id", "vector_score", "hybrid_score", F.col("final").alias("score"), F.row_number().over(order).alias("rank"))


def children(parents: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (parent, child, chunk_index) of the chunks below summaries.

    ``parents(id, doc_id, node_type, section_path)``; ``records`` with id, doc_id, parent_id, node_type,
    chunk_index and section_path (without that column no path matches). Below a document summary are the chunks of its document, below
    another summary those that name it as parent; where there are none, those of its document whose
    section path begins with its own.
    """
    path = lambda df: (F.col("section_path") if "section_path" in df.columns else F.lit(None).cast("string"))
    tops = parents.where("node_type <> 'chunk'").select(F.col("id").alias("parent"), "doc_id", F.col("node_type").alias("__type"), path(parents).alias("__path")).distinct()
    chunks = records.where("node_type = 'chunk'").select(F.col("id").alias("child"), "doc_id", "parent_id", "chunk_index", path(records).alias("section_path"))
    of_doc = tops.where("__type = 'document_summary'").join(chunks, "doc_id").select("parent", "child", "chunk_index")
    own = tops.where("__type <> 'document_summary'").join(chunks.drop("doc_id"), F.col("parent") == F.col("parent_id")).select("parent", "child", "chunk_index")
    found = of_doc.unionByName(own)
    bare = tops.join(found.select("parent").distinct(), "parent", "left_anti")
    below = bare.join(chunks, "doc_id").where(F.col("section_path").startswith(F.col("__path"))).select("parent", "child", "chunk_index")
    return found.unionByName(below)


def expand_summaries(ranking: DataFrame, records: DataFrame, most: int = CANDIDATES, child_order: list[Column] | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Chunks in the order of admission: a chunk stands for itself, a summary for its children.

    ``ranking(qid, id, rank, vector_score)``; for ``records`` see ``children``. Children go by chunk
    number, or by ``child_order`` over the columns of ``scores(qid, parent, child, ...)``. The first
    place of a chunk counts. Rows (qid, id, vector_score, place).
    """
    top = ranking.join(records.select("id", "doc_id", "node_type", *[c for c in records.columns if c == "section_path"]), "id")
    own = top.where("node_type = 'chunk'").select("qid", "id", "vector_score", "rank", F.lit(0).cast("long").alias("within"))
    met = top.select("qid", F.col("id").alias("parent"), "vector_score", "rank").join(children(top, records), "parent")
    if scores is not None:
        met = met.join(scores, ["qid", "parent", "child"])
    first = Window.partitionBy("qid", "parent").orderBy("chunk_index", "child")
    kept = met.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most)
    order = Window.partitionBy("qid", "parent").orderBy(*(child_order or [F.col("chunk_index")]), "child")
    below = kept.withColumn("within", F.row_number().over(order).cast("long"))
    every = own.unionByName(below.select("qid", F.col("child").alias("id"), "vector_score", "rank", "within"))
    once = every.groupBy("qid", "id").agg(F.min(F.struct("rank", "within", "vector_score")).alias("f"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("f.rank", "f.within", "id"))
    return once.select("qid", "id", "f.vector_score", place.alias("place"))


def within_budget(offered: DataFrame, budget: int | Column) -> DataFrame:
    """Texts of each query, in order, up to a token budget; the one that crosses it is cut.

    ``offered(qid, id, place, content)``, with ``ordinal`` where a query stands for several planned
    ones: each of these has the whole budget, in the order of the ordinals, and none admits an id
    that one before has. A text that no longer fits and can't be cut is dropped and later, smaller
    ones still count, so the walk depends on all before it: it is a fold over the array of a
    query's offers, at most some hundred. Rows (qid, ordinal if given, id, place, content, tokens,
    truncated); ``budget`` may be a column that is one value for each query.
    """
    several = "ordinal" in offered.columns
    limit = (budget if isinstance(budget, Column) else F.lit(budget)).cast("long")
    ordinal = F.col("ordinal").cast("int") if several else F.lit(0)
    offer = F.struct(ordinal.alias("ordinal"), "place", "id", F.coalesce("content", F.lit("")).alias("content"))
    each = offered.withColumn("__limit", limit).groupBy("qid").agg(F.sort_array(F.collect_list(offer)).alias("offers"), F.max("__limit").alias("limit"))
    kind = {c: offered.schema[c].dataType.simpleString() for c in ("id", "place")}
    none = F.array().cast(f"array<struct<ordinal:int,id:{kind['id']},place:{kind['place']},content:string,tokens:bigint,truncated:boolean>>")

    def admit(state: Column, x: Column) -> Column:
        used = F.when(x["ordinal"] == state["ordinal"], state["used"]).otherwise(0)
        left = F.col("limit") - used
        whole = tx.context_estimate(x["content"]) <= left
        text = F.when(whole, x["content"]).otherwise(tx.fitted(x["content"], left))
        cost = tx.context_estimate(text)
        known = F.exists(state["kept"], lambda k: k["id"].eqNullSafe(x["id"]))
        good = (left > 0) & (whole | (text != "")) & ~known
        row = F.struct(x["ordinal"].alias("ordinal"), x["id"].alias("id"), x["place"].alias("place"), text.alias("content"), cost.alias("tokens"), (~whole).alias("truncated"))
        kept = F.when(good, F.concat(state["kept"], F.array(row))).otherwise(state["kept"])
        return F.struct(x["ordinal"].alias("ordinal"), (used + F.when(good, cost).otherwise(0)).alias("used"), kept.alias("kept"))

    start = F.struct(F.lit(0).alias("ordinal"), F.lit(0).cast("long").alias("used"), none.alias("kept"))
    out = each.select("qid", F.inline(F.aggregate("offers", start, admit, lambda s: s["kept"])))
    return out if several else out.drop("ordinal")


def admitted(offered: DataFrame, texts: DataFrame, budget: int | Column) -> DataFrame:
    """``within_budget`` of offers (qid, id, place, with ``ordinal`` where given) whose texts stand in ``texts(id, content)``.

    Lengths travel with every offer, texts with those only that the budget admits by its lengths: these are walked
    again with their texts. A cut that loses so much white space at its end that more could follow, and ids with several
    texts, are the exception: all offers of such a query are walked with their texts.
    """
    several = "ordinal" in offered.columns
    limit = (budget if isinstance(budget, Column) else F.lit(budget)).cast("long")
    ordinal = F.col("ordinal").cast("int") if several else F.lit(0)
    every = stage(offered.select("qid", ordinal.alias("ordinal"), "place", "id", limit.alias("__limit")), "offers")
    sizes = stage(texts.select("id", F.length(F.coalesce("content", F.lit(""))).alias("n")), "text-sizes")
    offer = F.struct("ordinal", "place", "id", "n")
    each = every.join(sizes, "id").groupBy("qid").agg(F.sort_array(F.collect_list(offer)).alias("offers"), F.max("__limit").alias("limit"))
    kind = {c: every.schema[c].dataType.simpleString() for c in ("id", "place")}
    none = F.array().cast(f"array<struct<ordinal:int,id:{kind['id']},place:{kind['place']},cut:boolean>>")

    def admit(state: Column, x: Column) -> Column:
        used = F.when(x["ordinal"] == state["ordinal"], state["used"]).otherwise(0)
        left = F.col("limit") - used
        cost = F.ceil(x["n"] / F.lit(4.0)).cast("long") + tx.OVERHEAD_TOKENS
        whole = cost <= left
        known = F.exists(state["kept"], lambda k: k["id"].eqNullSafe(x["id"]))
        good = (left > 0) & (whole | (left >= tx.LEAST_BLOCK_TOKENS)) & ~known
        row = F.struct(x["ordinal"].alias("ordinal"), x["id"].alias("id"), x["place"].alias("place"), (~whole).alias("cut"))
        kept = F.when(good, F.concat(state["kept"], F.array(row))).otherwise(state["kept"])
        return F.struct(x["ordinal"].alias("ordinal"), (used + F.when(good, F.least(cost, left)).otherwise(0)).alias("used"), kept.alias("kept"))

    start = F.struct(F.lit(0).alias("ordinal"), F.lit(0).cast("long").alias("used"), none.alias("kept"))
    double = F.size("offers") > F.size(F.array_distinct(F.transform("offers", lambda x: F.struct(x["ordinal"], x["id"]))))
    chosen = stage(each.select("qid", "limit", double.alias("double"), F.aggregate("offers", start, admit, lambda s: s["kept"]).alias("kept")), "admitted")
    few = chosen.where("NOT double").select("qid", "limit", F.inline("kept"))
    walked = stage(within_budget(few.join(texts.select("id", "content"), "id"), F.col("limit")), "walked")
    # a query is done if all that was chosen was admitted and what a cut left over admits nothing more
    cuts = few.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("limit").alias("limit"))
    used = walked.groupBy("qid", "ordinal").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("n"), F.bool_or("truncated").alias("cut"))
    most = used.groupBy("qid").agg(F.sum("n").alias("got"), F.min(F.when(F.col("cut"), F.col("used"))).alias("used"))
    short = cuts.join(most, "qid", "left").where((F.coalesce("got", F.lit(0)) < F.col("n")) | (F.col("limit") - F.col("used") >= tx.OVERHEAD_TOKENS)).select("qid")
    again = stage(short.unionByName(chosen.where("double").select("qid")), "walked-again")
    rest = within_budget(every.join(again, "qid").join(texts.select("id", "content"), "id"), F.col("__limit"))
    out = walked.join(again, "qid", "left_anti").unionByName(rest)
    return out if several else out.drop("ordinal")


def trusted_groups(records: DataFrame, trust: DataFrame) -> DataFrame:
    """Adds ``source_group``: the record's own, else that of its source's trust entry, else ungrouped."""
    known = trust.select("source_hash", F.col("source_group").alias("__trusted"))
    own = F.col("source_group") if "source_group" in records.columns else F.lit(None).cast("string")
    joined = records.withColumn("__own", own).drop("source_group").join(known, "source_hash", "left")
    group = F.lower(F.trim(F.coalesce(F.nullif(F.col("__own"), F.lit("")), F.col("__trusted"), F.lit("ungrouped"))))
    valid = F.when(group.isin(*SOURCE_WEIGHTS), group).otherwise("ungrouped")
    return joined.withColumn("source_group", valid).drop("__own", "__trusted")

