"""From questions to cited contexts: retrieval, summaries expanded, budgets, planned queries, labels.

Everything takes any number of questions at once. ``questions(qid, question, vector)`` may have an
``ordinal``: then a qid stands for a conversation with several planned queries.

Defined cases: a question without a vector finds nothing; without any keyword only vectors count;
repeated records are offered once; other columns of questions are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import retrieval
from lodestone.plans import context
from lodestone.sources.staging import stage


def _pool(vectors: DataFrame, words: DataFrame, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(scored candidates of every question, keywords (qid, asked) of questions by their own key)."""
    several = "ordinal" in questions.columns
    key = F.struct("qid", (F.col("ordinal") if several else F.lit(0)).alias("ordinal"))
    each = questions.select(key.alias("qid"), "question", "vector")
    near = retrieval.knn(vectors, each.select("qid", "vector"), k)
    asked = stage(retrieval.asked_words(each), "ask-terms")
    candidates = near.select("qid", "id", "score").join(asked, "qid").join(words, "id")
    return stage(retrieval.pooled(candidates), "ask-pool"), asked


def _child_scores(top: DataFrame, records: DataFrame, words: DataFrame, pool: DataFrame, asked: DataFrame, weight: float, rrf_k: int) -> DataFrame:
    """Rows (qid, parent, child, final, vector) of the children of ranked summaries.

    A child takes its summary's vector score. One that is in the question's pool has its fused rank
    there; another one has that of a first rank if it shares a word with the question, else none.
    Keywords of questions travel to those of the children; neither goes further.
    """
    tops = top.join(records.select("id", "doc_id", "node_type", "section_path"), "id").where("node_type <> 'chunk'")
    below = retrieval.children(tops, records).select("parent", "child").distinct()
    met = tops.select("qid", F.col("id").alias("parent"), F.col("vector_score").alias("vector")).join(below, "parent")
    numbers = pool.groupBy("qid").agg(F.max("max_rrf").alias("max_rrf"), F.bool_or("lexical").alias("lexical"))
    own = pool.select("qid", F.col("id").alias("child"), F.col("rrf").alias("own_rrf"))
    joined = met.join(numbers, "qid").join(own, ["qid", "child"], "left").join(asked, "qid").join(words.withColumnRenamed("id", "child"), "child")
    late = F.when(F.arrays_overlap("asked", "words"), F.lit(1.0) / (rrf_k + 1)).otherwise(0.0)
    blend = retrieval.blended(F.col("vector"), F.coalesce("own_rrf", late), F.col("max_rrf"), F.col("lexical"), weight)
    return joined.select("qid", "parent", "child", F.round(blend * retrieval.source_weight(F.col("source_group")), 4).alias("final"), "vector")


def offers(vectors: DataFrame, records: DataFrame, trust: DataFrame, questions: DataFrame, k: int = retrieval.CANDIDATES, weight: float = retrieval.LEXICAL_WEIGHT, min_score: float = retrieval.MIN_SCORE, relative: float = retrieval.RELATIVE_CUTOFF) -> DataFrame:
    """Chunks in the order in which they are offered: (qid, ordinal, place, id, vector_score, score).

    ``vectors(id, vector)`` and ``records`` (columns of an index record); ``trust(source_hash,
    source_group)``. Candidates are gated, summaries stand for their children, ranked among
    themselves by (score, vector score). Texts are read once, for the keywords of each record; none travels with a candidate.
    """
    words = stage(retrieval.trusted_groups(records, trust).select("id", tx.keywords(F.col("content")).alias("words"), "source_group"), "record-words")
    pool, asked = _pool(vectors, words, questions, k)
    top = stage(retrieval.gated(pool, weight, min_score, relative), "ask-top")
    heads = stage(records.select(*[c for c in ("id", "doc_id", "parent_id", "node_type", "chunk_index", "section_path") if c in records.columns]), "record-heads")
    scores = stage(_child_scores(top, heads, words, pool, asked, weight, retrieval.RRF_K), "child-scores")
    order = [F.desc("final"), F.desc("vector")]
    placed = retrieval.expand_summaries(top, heads, k, order, scores)
    own = top.select("qid", "id", F.col("score").alias("own_score"))
    best = scores.groupBy("qid", F.col("child").alias("id")).agg(F.max("final").alias("child_score"))
    scored = placed.join(own, ["qid", "id"], "left").join(best, ["qid", "id"], "left")
    return stage(scored.select("qid.qid", "qid.ordinal", "place", "id", "vector_score", F.coalesce("own_score", "child_score").alias("score")), "offers")


def retrieved(offered: DataFrame, records: DataFrame, budget: int | Column, exclude: DataFrame | None = None) -> DataFrame:
    """The offered chunks that the budget admits: (qid, ordinal, place, id, content, tokens, truncated).

    ``exclude(qid, id)``: ids that are known already. Planned queries of one qid follow each other and
    admit no id twice.
    """
    left = offered if exclude is None else offered.join(exclude.select("qid", "id").distinct(), ["qid", "id"], "left_anti")
    return retrieval.admitted(left, records, budget)


def merged(admitted: DataFrame, offered: DataFrame) -> DataFrame:
    """What the planned queries of a qid have admitted as one ranking: adds score, vector_score and ``rank``."""
    scores = offered.select("qid", "ordinal", "id", "score", "vector_score")
    joined = admitted.join(scores, ["qid", "ordinal", "id"])
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("vector_score"), "id")
    return joined.withColumn("rank", F.row_number().over(order))


def tool_result(ranked: DataFrame, records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The rows of a local search as a model sees them: label, chunk, score, where it stands, content.

    ``ranked(qid, rank, id, content, score, vector_score)``; ``known(conv_id, seq, key)``: what the
    conversation has cited before, so that a record keeps its number.
    """
    own = ranked.select(F.col("qid").alias("conv_id"), (F.col("rank") + 1_000_000).cast("long").alias("seq"), F.col("id").alias("key"))
    cited = own if known is None else known.select("conv_id", F.col("seq").cast("long").alias("seq"), "key").unionByName(own)
    labels = context.cited(cited).where("seq > 1000000").select(F.col("conv_id").alias("qid"), F.col("key").alias("id"), "label")
    where = records.select("id", tx.source_name(F.col("source_pdf_name"), F.col("source_pdf_path"), F.col("file_path")).alias("__name"), "section_path", tx.page_label(F.col("page_start"), F.col("page_end")).alias("__pages"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    joined = ranked.join(labels, ["qid", "id"]).join(where, "id")
    location = F.concat_ws(" :: ", filled("__name"), filled("section_path"), filled("__pages"))
    return joined.select("qid", "rank", F.col("label").alias("citation"), F.col("id").alias("chunk_id"), "score", "vector_score", location.alias("location"), "content")


def web_result(results: DataFrame, budget: int | Column) -> DataFrame:
    """Rows of a web search within a budget: (qid, place, url, title, snippet, tokens, truncated, citation).

    ``results(qid, place, title, url, snippet)``, and ``budget`` where that differs. The title's and url's tokens are part of a row's cost.
    """
    head = F.concat_ws("\n", F.coalesce("title", F.lit("")), "url")
    own = [c for c in results.columns if c == "budget"]
    kept = retrieval.within_budget(results.select("qid", "place", F.col("url").alias("id"), F.concat(head, F.lit("\n"), F.coalesce("snippet", F.lit(""))).alias("content"), *own), budget)
    cited = context.cited(kept.select(F.col("qid").alias("conv_id"), F.col("place").alias("seq"), F.col("id").alias("key")), "W")
    labels = cited.select(F.col("conv_id").alias("qid"), F.col("key").alias("id"), "label")
    joined = kept.join(labels, ["qid", "id"]).join(results.select("qid", F.col("url").alias("id"), "title", F.length(head).alias("__head")), ["qid", "id"])
    return joined.select("qid", "place", F.col("id").alias("url"), "title", F.substring("content", F.col("__head") + 2, F.length("content")).alias("snippet"), "tokens", "truncated", F.col("label").alias("citation"))


def sources(local: DataFrame, web: DataFrame) -> DataFrame:
    """Local and then web sources of each conversation: (qid, place, citation, kind, key)."""
    one = local.select("qid", F.lit(0).alias("__kind"), F.col("rank").alias("__at"), "citation", F.lit("local").alias("kind"), F.col("chunk_id").alias("key"))
    two = web.select("qid", F.lit(1).alias("__kind"), F.col("place").alias("__at"), "citation", F.lit("web").alias("kind"), F.col("url").alias("key"))
    number = F.row_number().over(Window.partitionBy("qid").orderBy("__kind", "__at", "key"))
    return one.unionByName(two).select("qid", number.alias("place"), "citation", "kind", "key")


def vector_rows(results: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of a search beside the index records that they name; one that the index has lost keeps its own text.

    ``results(qid, chunk_id, content, location, score, citation)``.
    """
    known = records.select(F.col("id").alias("chunk_id"), F.col("content").alias("__content"), "node_type", "file_path", "chunk_index")
    joined = results.join(known, "chunk_id", "left")
    lost = F.col("__content").isNull()
    return joined.select(
        "qid", F.col("chunk_id").alias("id"), F.coalesce("__content", "content").alias("content"), F.coalesce("node_type", F.lit("chunk")).alias("node_type"),
        F.when(lost, F.col("location")).otherwise(F.col("file_path")).alias("file_path"), "chunk_index", "score", "citation",
    )
