"""The block index: chunks of blocks with headers, term search, reranking, modes, cited answers.

Tables: ``documents(doc_id, title, ...)``, ``blocks(doc_id, page_num, reading_order, block_id,
modality, content)``, ``chunks(chunk_id, doc_id, text, block_ids, ...)``, ``chunk_vectors(chunk_id,
vector)``.

Defined cases: null and empty texts are never found; a question without terms finds nothing by
terms; ties go by chunk id; a chunk or document that a table lacks drops out of joins, but a block
whose document is missing is titled by its id; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import blocks as bk
from lodestone.operators import retrieval

VECTOR_HITS = TERM_HITS = 24
RERANKED = 12
MOST_TERMS = 16
VECTOR_MODES, TERM_MODES = ("hybrid", "vector", "local"), ("hybrid", "bm25", "text", "global")


def chunk_blocks(chunks: DataFrame) -> DataFrame:
    """Rows (chunk_id, block_id, ordinal)."""
    return chunks.select("chunk_id", F.posexplode("block_ids").alias("ordinal", "block_id"))


def blocks_of(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of chunks in their order: (chunk_id, ordinal, block columns)."""
    return chunk_blocks(chunks).join(blocks, "block_id")


def query_terms(question: Column) -> Column:
    """The first terms of a question, each once."""
    return F.array_distinct(F.slice(tx.terms(question), 1, MOST_TERMS))


def term_search(chunks: DataFrame, questions: DataFrame, k: int = TERM_HITS) -> DataFrame:
    """The k best chunks of each question by BM25 with term counts: (qid, chunk_id, score, rank).

    A chunk qualifies by any of the question's first 16 terms. k1 is 1.2, b 0.75 and the least idf
    1e-6, as in SQLite's full-text index. One pass over the texts stages the postings of the
    questions' terms and a row for each chunk; postings shuffle once, by chunk, and up to ``retrieval.FEW_TERMS``
    rows of questions and terms travel to them, so that scores are summed where a chunk lies. A
    stored ``TermIndex`` gives the same without reading texts.
    """
    asked = questions.select("qid", F.explode(query_terms(F.col("question"))).alias("term"))
    words = chunks.select(F.col("chunk_id").alias("id"), tx.terms(F.col("text")).alias("terms")).withColumn("dl", F.size("terms"))
    kept = retrieval.with_lengths(words, asked)
    n, mean = retrieval.lengths_of(kept)
    near = kept.where("term IS NOT NULL").select(F.col("id").alias("chunk_id"), "dl", "term").repartition("chunk_id")
    counted = near.groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weights = asked.join(df, "term").select("qid", "term", idf.alias("idf"))
    weights = F.broadcast(weights) if asked.count() <= retrieval.FEW_TERMS else weights
    part = F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.lit(max(mean, 1e-9))))
    scored = counted.join(weights, "term").groupBy("qid", "chunk_id").agg(F.sum(part).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_search(vectors: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = VECTOR_HITS) -> DataFrame:
    """The k nearest chunks of each question by cosine: (qid, chunk_id, score, rank)."""
    known = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("id"), "vector")
    return retrieval.knn(known, questions.select("qid", "vector"), k, "cosine").withColumnRenamed("id", "chunk_id")


def of_documents(hits: DataFrame, chunks: DataFrame, docs: DataFrame | None) -> DataFrame:
    """Hits in some documents only. This follows the choice of the best, so fewer may be left."""
    if docs is None:
        return hits
    inside = chunks.select("chunk_id", "doc_id").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    kept = hits.join(inside.select("chunk_id"), "chunk_id", "left_semi")
    again = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return kept.withColumn("rank", again)


def rerank(candidates: DataFrame, questions: DataFrame, k: int = RERANKED) -> DataFrame:
    """The k best of ``candidates(qid, chunk_id, text, score)`` by score plus the share of the question's terms that the text holds."""
    asked = questions.select("qid", F.array_distinct(tx.terms(F.col("question"))).alias("__q"))
    joined = candidates.join(asked, "qid")
    shared = F.size(F.array_intersect("__q", tx.terms(F.col("text")))) / F.greatest(F.lit(1), F.size("__q"))
    scored = joined.withColumn("score", F.col("score") + shared).drop("__q")
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, mode: str = "hybrid", docs: DataFrame | None = None) -> DataFrame:
    """Reranked chunks of ``questions(qid, question, vector)`` by one of the modes: (qid, chunk_id, doc_id, text, score, rank)."""
    mode = (mode or "hybrid").lower()
    lists = []
    if mode in VECTOR_MODES:
        lists.append(of_documents(vector_search(vectors, chunks, questions), chunks, docs))
    if mode in TERM_MODES:
        lists.append(of_documents(term_search(chunks, questions), chunks, docs))
    if not lists:
        raise ValueError(f"unknown mode {mode}")
    fused = retrieval.fuse([x.select("qid", F.col("chunk_id").alias("id"), "rank") for x in lists])
    known = fused.select("qid", F.col("id").alias("chunk_id"), F.col("rrf").alias("score")).join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
    return rerank(known, questions)


def evidence(hits: DataFrame, chunks: DataFrame, blocks: DataFrame, documents: DataFrame, top_k: int, window: int = 1) -> DataFrame:
    """Blocks of the first ``top_k`` hits with their neighbours, each at its first place.

    ``hits(qid, chunk_id, score, rank)``. Rows (qid, place, chunk_id, block_id, doc_id, title, page_num,
    modality, score, content, snippet, cited): the first ``4 top_k`` blocks with content are cited.
    """
    best = hits.where(F.col("rank") <= top_k).select("qid", "chunk_id", "score", "rank")
    own = best.join(chunk_blocks(chunks), "chunk_id")
    anchors = own.select("block_id").distinct().join(blocks, "block_id").select("block_id", "doc_id", "page_num", "reading_order")
    near = bk.neighbours(blocks, anchors, window).select(F.col("anchor_id").alias("__anchor"), F.col("block_id").alias("__near"), "reading_order")
    every = own.join(near, F.col("block_id") == F.col("__anchor"))
    first = every.groupBy("qid", F.col("__near").alias("block_id")).agg(F.min(F.struct("rank", "ordinal", "reading_order", "chunk_id", "score")).alias("f"))
    full = first.join(blocks.select("block_id", "doc_id", "page_num", "modality", "content"), "block_id").join(documents.select("doc_id", "title"), "doc_id", "left")
    order = Window.partitionBy("qid").orderBy("f.rank", "f.ordinal", "f.reading_order", "block_id")
    filled = (F.coalesce("content", F.lit("")) != "").cast("int")
    placed = full.withColumns({"place": F.row_number().over(order), "__n": F.sum(filled).over(order)})
    cited = (filled == 1) & (F.col("__n") <= max(top_k, 4 * top_k))
    return placed.select(
        "qid", "place", "f.chunk_id", "block_id", "doc_id", F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), "page_num", "modality",
        "f.score", F.coalesce("content", F.lit("")).alias("content"), tx.snippet(F.col("content"), 400).alias("snippet"), cited.alias("cited"),
    )


def contexts(found: DataFrame) -> DataFrame:
    """The evidence of each question as one text with [C#] headers: (qid, context)."""
    head = F.concat(F.lit("[C"), "place", F.lit("] "), "title", F.lit(", page "), F.col("page_num").cast("string"), F.lit(", block "), F.col("block_id").cast("string"), F.lit(", "), "modality")
    parts = F.sort_array(F.collect_list(F.struct("place", F.concat(head, F.lit("\n"), "content").alias("text"))))
    return found.groupBy("qid").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("context"))


def fallback_answers(context: DataFrame, most: int = 4, chars: int = 300) -> DataFrame:
    """Answers without a model: the first headers of a context, each with the line below it."""
    lines = F.filter(F.transform(F.split("context", "\n"), lambda x: tx.stripped(x)), lambda x: x != "")
    each = context.select("qid", lines.alias("l"))
    heads = F.slice(F.filter("l", lambda x: x.startswith("[C")), 1, most)
    below = lambda x: F.coalesce(F.try_element_at("l", (F.array_position("l", x) + 1).cast("int")), F.lit(""))
    shown = F.transform(heads, lambda x: F.concat(x, F.lit(": "), F.substring(below(x), 1, chars)))
    intro = F.lit("Local generator unavailable. Most relevant retrieved evidence:\n")
    none = F.lit("I could not find relevant local source blocks for that question.")
    return each.select("qid", F.when(F.size("l") == 0, none).otherwise(F.concat(intro, F.array_join(shown, "\n"))).alias("answer"))


#: Orders in which the tables are listed (fixed values).
LISTED = {"documents": ["title", "doc_id"], "blocks": ["doc_id", "page_num", "reading_order"], "chunks": ["doc_id", "chunk_id"]}


def listing(name: str, table: DataFrame) -> DataFrame:
    """A table of the index in its own order."""
    return table.orderBy(*LISTED[name])


def store_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (name, n) of some tables."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def rebuilt(blocks: DataFrame, embed, max_tokens: int, overlap_tokens: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A whole index anew: (chunks, their vectors, one row of counts).

    ``embed`` makes a column of vectors from a column of texts.
    """
    chunks = bk.pack_blocks(blocks, max_tokens, overlap_tokens)
    vectors = chunks.select("chunk_id", "doc_id", embed(F.col("text")).alias("vector"))
    groups = chunks.groupBy("duplicate_group").agg(F.count(F.lit(1)).alias("n"))
    counts = chunks.agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"))
    repeated = groups.agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"))
    return chunks, vectors, counts.withColumn("duplicate_groups", repeated.scalar())
