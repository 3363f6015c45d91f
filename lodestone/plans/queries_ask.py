"""Registered queries of retrieval from question to cited context, and of the block index."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone import corpus
from lodestone.corpus import RECORDS_SQL, keywords_sql, table
from lodestone.functions import text as tx
from lodestone.functions import vectors as vec
from lodestone.operators import ann, classic, retrieval
from lodestone.plans import ask, context, sql_functions
from lodestone.plans.registry import query
from lodestone.sources import staging
from lodestone.sources.term_index import TermIndex

# --- texts


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'own.pdf' WHEN 1 THEN 'p.pdf' WHEN 2 THEN 'f.md' ELSE 'source' END AS name, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '/api/pdfs/a%20b%2F' || doc_id || '%C3%A9/view' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '#page=' || (doc_id % 3) END END AS url FROM documents""")
def source_links(spark, sf):
    """Names and addresses of the sources that records are shown with."""
    d = F.col("doc_id")
    name = tx.source_name(F.when(d % 4 == 0, "own.pdf"), F.when(d % 4 == 1, r"x\y/p.pdf"), F.when(d % 4 == 2, "a/f.md").otherwise(" "))
    key = F.when(d % 5 == 0, "").otherwise(F.concat(F.lit("a b/"), d, F.lit("é")))
    return table(spark, sf, "documents").select("doc_id", name.alias("name"), tx.pdf_url(key, "view", d % 3).alias("url"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 40 WHEN 1 THEN greatest(1, least(doc_id - 50, 200)) ELSE 40 END::BIGINT AS n, round(CASE doc_id % 3 WHEN 1 THEN least(1.0, greatest(0.0, (doc_id - 50) / 100.0)) ELSE 0.25 END, 6)::DOUBLE AS share FROM documents""")
def bounded_numbers(spark, sf):
    d = F.col("doc_id")
    given = F.when(d % 3 == 1, (d - 50).cast("string")).when(d % 3 == 2, "many")
    part = F.when(d % 3 == 1, ((d - 50) / 100.0).cast("string")).when(d % 3 == 2, "most")
    return table(spark, sf, "documents").select("doc_id", tx.whole_number(given, 40, 1, 200).alias("n"), F.round(tx.share(part, 0.25), 6).alias("share"))


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, 80 + doc_id % 400 AS b FROM documents), c AS (SELECT *, ceil(length(t) / 4.0) + 64 <= b AS fits, regexp_replace(substr(t, 1, greatest(0, 4 * (b - 64) - 43)::BIGINT), '[\s\x0B\x{00A0}\x{2000}-\x{200A}\x{3000}]+$', '') AS cut FROM t)
    SELECT doc_id, md5(CASE WHEN fits THEN t WHEN b < 96 OR cut = '' THEN '' ELSE cut || chr(10) || chr(10) || '[Context truncated to fit prompt budget.]' END) AS text FROM c""")
def fitted_texts(spark, sf):
    """Whole documents fitted to budgets of 80 to 479 tokens."""
    out = tx.fitted(F.coalesce("text", F.lit("")), 80 + F.col("doc_id") % 400)
    return table(spark, sf, "documents").select("doc_id", F.md5(out).alias("text"))


@query(r"""SELECT answer_id, unnest(fs) AS fragment, unnest(range(0, len(fs)))::INT AS fragment_no FROM (SELECT conv_id || ':' || turn AS answer_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])[\s\x0B]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS fs FROM conversations WHERE role = 'assistant')""")
def claim_fragments(spark, sf):
    """Sentences and lines of all answers, in every language."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("answer_id"), F.posexplode(tx.claim_fragments(F.coalesce("text", F.lit("")))).alias("fragment_no", "fragment"))


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t, length(coalesce(text, '')) // 3 AS n FROM conversations), p AS (SELECT *, substr(t, 1, n) AS a, substr(t, n + 1, n) AS b, substr(t, 2 * n + 1) AS c FROM t)
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN b WHEN 1 THEN a || c ELSE b || c END AS thinking, CASE turn % 3 WHEN 0 THEN a || c WHEN 1 THEN b ELSE a END AS answer FROM p""")
def thinking_parts(spark, sf):
    """Thinking and answers of all turns, of which some third or two, or all from some place on, is thought."""
    from lodestone.streaming.incremental import thinking_and_answer

    text = F.coalesce("text", F.lit(""))
    n = F.floor(F.length(text) / 3).cast("int")
    a, b, c = F.substring(text, F.lit(1), n), F.substring(text, n + 1, n), F.substring(text, 2 * n + 1, F.length(text))
    t = F.col("turn") % 3
    think = lambda x: F.concat(F.lit("<think>"), x, F.lit("</think>"))
    given = F.when(t == 0, F.concat(a, think(b), c)).when(t == 1, F.concat(think(a), b, think(c))).otherwise(F.concat(a, F.lit("<think>"), b, c))
    thinking, answer = thinking_and_answer(given)
    return table(spark, sf, "conversations").select("conv_id", "turn", thinking.alias("thinking"), answer.alias("answer"))


@query("""SELECT conv_id, turn, coalesce(text, '') AS content, CASE turn % 3 WHEN 0 THEN 'deep' WHEN 1 THEN 'beside' ELSE '' END AS thinking, 'stop' AS done_reason, (turn % 3)::INT AS tool_calls FROM conversations""")
def reply_parts(spark, sf):
    """Content, thinking and tool calls of model replies in JSON."""
    t = F.col("turn")
    call = F.struct(F.lit("search").alias("name"))
    message = F.struct(F.col("text").alias("content"), F.when(t % 3 == 0, "deep").alias("reasoning"), F.array_repeat(call, (t % 3).cast("int")).alias("tool_calls"))
    reply = F.to_json(F.struct(message.alias("message"), F.when(t % 3 == 1, "beside").alias("reasoning_content"), F.lit("stop").alias("done_reason")))
    parts = context.message_parts(reply)
    return table(spark, sf, "conversations").select("conv_id", "turn", *[v.alias(k) for k, v in parts.items()])


_PLANNED = """WITH b AS (SELECT item_id, trim(text) AS q, item_id % 3 AS k FROM benchmark WHERE trim(text) <> ''), f AS (SELECT item_id, q, [q] AS l FROM b),
    a AS (SELECT item_id AS qid, CASE k WHEN 0 THEN [q, 'alpha?'] WHEN 1 THEN [q, 'beta'] ELSE [q, 'gamma', 'delta'] END AS qs FROM b)
    SELECT qid, unnest(range(0, len(qs)))::INT AS ordinal, unnest(qs) AS question FROM a"""


@query(_PLANNED)
def planned_queries(spark, sf):
    """Search queries of all benchmark items, from replies in the forms that planners give; the question comes first, each once."""
    b = table(spark, sf, "benchmark").where("trim(text) <> ''")
    reply = F.when(F.col("item_id") % 3 == 0, F.to_json(F.array(F.lit("alpha?"), F.col("text")))).when(F.col("item_id") % 3 == 1, F.lit('```json\n["beta"]\n```')).otherwise("gamma\ndelta")
    return context.planned_queries(b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), reply.alias("reply")))


@query(_PLANNED)
def sql_planned_queries(spark, sf):
    """The same through SQL: a table function called with LATERAL for each item."""
    sql_functions.register(spark)
    reply = """CASE item_id % 3 WHEN 0 THEN to_json(array('alpha?', text)) WHEN 1 THEN '```json\\n["beta"]\\n```' ELSE 'gamma\\ndelta' END"""
    return spark.sql(f"SELECT b.item_id AS qid, p.ordinal, p.query AS question FROM {{items}} b, LATERAL plan_queries({reply}, b.text, 4) p WHERE trim(b.text) <> ''", items=table(spark, sf, "benchmark"))


# --- records and their children

_TREE = """t AS (SELECT 'd' || c_nationkey AS doc_id, 'c' || c_custkey AS id, 'chunk' AS node_type, CASE WHEN c_custkey % 4 = 0 THEN 's' || c_nationkey || ':' || (c_custkey % 8) ELSE '' END AS parent_id, c_custkey AS chunk_index, 'Book > Part ' || (c_custkey % 3) || ' > x' AS section_path FROM customer),
    p AS (SELECT DISTINCT 'd' || c_nationkey AS doc_id, 's' || c_nationkey || ':' || k AS id, 'section_summary' AS node_type, 'd' || c_nationkey AS parent_id, -1 AS chunk_index, 'Book > Part ' || (k % 3) AS section_path FROM customer, (VALUES (0), (1), (4)) v(k)),
    q AS (SELECT DISTINCT 'd' || c_nationkey AS doc_id, 'd' || c_nationkey AS id, 'document_summary' AS node_type, '' AS parent_id, -1 AS chunk_index, 'Book' AS section_path FROM customer)"""


def _tree(spark, sf):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(spark, sf, "customer")
    doc = F.concat(F.lit("d"), n)
    columns = lambda *x: [v.alias(k) for k, v in zip(("doc_id", "id", "node_type", "parent_id", "chunk_index", "section_path"), x, strict=True)]
    node = lambda k: F.concat(F.lit("s"), n, F.lit(":"), k)
    one = F.lit(-1).cast("long")
    chunks = rows.select(*columns(doc, F.concat(F.lit("c"), c), F.lit("chunk"), F.when(c % 4 == 0, node(c % 8)).otherwise(""), c, F.concat(F.lit("Book > Part "), c % 3, F.lit(" > x"))))
    parts = rows.select("c_nationkey").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(4))))
    sums = parts.select(*columns(doc, node(F.col("k")), F.lit("section_summary"), doc, one, F.concat(F.lit("Book > Part "), F.col("k") % 3)))
    tops = rows.select("c_nationkey").distinct().select(*columns(doc, doc, F.lit("document_summary"), F.lit(""), one, F.lit("Book")))
    return chunks.unionByName(sums).unionByName(tops)


@query(f"""WITH {_TREE}, own AS (SELECT p.id AS parent, t.id AS child FROM p JOIN t ON t.parent_id = p.id UNION ALL SELECT q.id, t.id FROM q JOIN t USING (doc_id))
    SELECT * FROM own UNION ALL SELECT p.id, t.id FROM p JOIN t ON t.doc_id = p.doc_id AND starts_with(t.section_path, p.section_path) WHERE p.id NOT IN (SELECT parent FROM own)""")
def children_of_summaries(spark, sf):
    """Chunks below summaries: by document, by parent, and by section path where no chunk names the summary."""
    every = _tree(spark, sf)
    return retrieval.children(every, every).select("parent", "child")


@query(f"""WITH {_TREE}, own AS (SELECT p.id AS parent, t.id AS child, t.chunk_index FROM p JOIN t ON t.parent_id = p.id), a AS (SELECT * FROM own UNION ALL SELECT p.id, t.id, t.chunk_index FROM p JOIN t ON t.doc_id = p.doc_id AND starts_with(t.section_path, p.section_path) WHERE p.id NOT IN (SELECT parent FROM own)),
    r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY round(chunk_index % 7 / 10.0, 4) DESC, chunk_index % 2 DESC, child) AS place FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY chunk_index, child) AS n FROM a) WHERE n <= 80) SELECT parent, child, place FROM r""")
def children_ranked(spark, sf):
    """Children ranked within their summaries by (score, vector score)."""
    every = _tree(spark, sf)
    summaries = every.where("node_type = 'section_summary'")
    below = retrieval.children(summaries, every)
    i = F.col("chunk_index")
    scores = below.select(F.col("parent").alias("qid"), "parent", "child", F.round(i % 7 / 10.0, 4).alias("final"), (i % 2).alias("vector"))
    top = summaries.select(F.col("id").alias("qid"), "id", F.lit(1).alias("rank"), F.lit(1.0).alias("vector_score"))
    placed = retrieval.expand_summaries(top, every, child_order=[F.desc("final"), F.desc("vector")], scores=scores)
    return placed.select(F.col("qid").alias("parent"), F.col("id").alias("child"), F.col("place").cast("long").alias("place"))


# --- the composed ask


def _records(spark, sf):
    """A record for each vector: chunks, and a summary for each twentieth, with the documents' texts."""
    e, n = table(spark, sf, "embeddings"), F.col("vec_id")
    name = lambda k: F.concat(F.lit("v"), k)
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    summary = n % 20 == 7
    rows = e.join(texts, "vec_id", "left").select(
        name(n).alias("id"), F.lit("book").alias("doc_id"), F.when(summary, "").otherwise(name(F.floor(n / 20) * 20 + 7)).alias("parent_id"), F.when(summary, "section_summary").otherwise("chunk").alias("node_type"),
        n.alias("chunk_index"), F.coalesce("text", F.lit("")).alias("content"), F.concat(F.lit("Part "), F.floor(n / 20)).alias("section_path"), F.concat(F.lit("src"), F.col("label") % 4).alias("source_hash"),
        F.lit("book.pdf").alias("source_pdf_name"), F.lit("").alias("source_pdf_path"), F.lit("").alias("file_path"), n.alias("page_start"), n.alias("page_end"), F.col("embedding").alias("vector"),
    )
    groups = [(f"src{i}", g) for i, g in enumerate(retrieval.SOURCE_WEIGHTS)]
    return rows, spark.createDataFrame(groups, "source_hash string, source_group string")


_ASK = f"""n AS (SELECT vec_id AS n, 'v' || vec_id AS id, CASE WHEN vec_id % 20 = 7 THEN 's' ELSE 'c' END AS kind, coalesce(text, '') AS content, CASE label % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.1 END::DOUBLE AS weight, embedding FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
    a AS (SELECT vec_id AS qid, embedding AS q, b.text AS question FROM embeddings JOIN benchmark b ON b.item_id = (vec_id // 20) % 40 WHERE vec_id % 20 = 0),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM (SELECT qid, question, n.*, 1 / (1 + list_sum(list_transform(list_zip(q, embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS score FROM a, n)) WHERE k <= 80),
    w AS (SELECT qid, id, {keywords_sql('content')} AS ws, {keywords_sql('question')} AS qs FROM c), st AS (SELECT qid, count(*) AS n, avg(len(ws)) AS mean FROM w GROUP BY qid), t AS (SELECT qid, id, len(ws) AS dl, unnest(ws) AS term, qs FROM w),
    df AS (SELECT qid, term, count(*) AS df FROM t GROUP BY ALL), b AS (SELECT t.qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / CASE WHEN mean <= 0 THEN 1 ELSE mean END))) AS bm25 FROM t JOIN df USING (qid, term) JOIN st USING (qid) WHERE list_contains(qs, term) GROUP BY ALL),
    r AS (SELECT qid, id, sum(1.0 / (60 + k)) AS rrf FROM (SELECT qid, id, k FROM c UNION ALL SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, id) FROM b) GROUP BY ALL),
    m AS (SELECT c.qid, id, n, kind, weight, question, score, rrf, max(rrf) OVER o AS mx, c.qid IN (SELECT qid FROM b) AS lex, greatest(0.5, 0.72 * max(score) OVER o) AS cutoff FROM c JOIN r USING (qid, id) WINDOW o AS (PARTITION BY c.qid)),
    top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, vs DESC, id) AS rank FROM (SELECT *, round(score, 4) AS vs, round(CASE WHEN lex THEN 0.8 * score + 0.2 * rrf / mx ELSE score END * weight, 4) AS final FROM m) WHERE vs >= cutoff),
    kids AS (SELECT *, row_number() OVER (PARTITION BY qid, parent ORDER BY cf DESC, id) AS within FROM (SELECT p.qid, p.id AS parent, p.rank, p.vs, x.id, round(CASE WHEN p.lex THEN 0.8 * p.vs + 0.2 * coalesce(m.rrf, CASE WHEN list_has_any({keywords_sql('p.question')}, {keywords_sql('x.content')}) THEN 1.0 / 61 ELSE 0 END) / p.mx ELSE p.vs END * x.weight, 4) AS cf
      FROM top p JOIN n x ON x.n // 20 = p.n // 20 AND x.kind = 'c' LEFT JOIN m ON m.qid = p.qid AND m.id = x.id WHERE p.kind = 's')),
    every AS (SELECT qid, id, rank, 0 AS within, vs FROM top WHERE kind = 'c' UNION ALL SELECT qid, id, rank, within, vs FROM kids),
    o AS (SELECT qid, id, vs, row_number() OVER (PARTITION BY qid ORDER BY rank, within, id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY rank, within) AS f FROM every) WHERE f = 1)"""


def _questions(spark, sf):
    q = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), (F.floor(F.col("vec_id") / 20) % 40).alias("item_id"))
    return q.join(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question")), "item_id").select("qid", "question", "vector")


@query(f"WITH {_ASK} SELECT qid, id, place, vs AS vector_score FROM o")
def ask_offers(spark, sf):
    """Every question's chunks in the order of admission, summaries expanded and their children ranked."""
    records, trust = _records(spark, sf)
    offered = ask.offers(records.select("id", "vector"), records, trust, _questions(spark, sf))
    return offered.select("qid", "id", F.col("place").cast("long").alias("place"), "vector_score")


_BUDGET = rf"""WITH RECURSIVE {_ASK}, l AS MATERIALIZED (SELECT qid, place, o.id, content, (ceil(length(content) / 4.0) + 64)::BIGINT AS cost FROM o JOIN n USING (id) WHERE o.id NOT IN ('v1', 'v3')), z AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS i FROM l),
    f AS (SELECT qid, 0 AS i, 0::BIGINT AS used, NULL::VARCHAR AS id, 0::BIGINT AS tokens, false AS cut FROM (SELECT DISTINCT qid FROM z) UNION ALL
      SELECT qid, i, used + tokens, CASE WHEN tokens > 0 THEN id END, tokens, cut FROM (SELECT f.qid, z.i, f.used, z.id, z.cost > 1024 - f.used AS cut, CASE WHEN 1024 - f.used <= 0 THEN 0 WHEN z.cost <= 1024 - f.used THEN z.cost WHEN 1024 - f.used < 96 THEN 0
        ELSE ceil((length(regexp_replace(substr(z.content, 1, (4 * (1024 - f.used - 64) - 43)::BIGINT), '[\s\x0B\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '')) + 43) / 4.0)::BIGINT + 64 END AS tokens FROM f JOIN z ON z.qid = f.qid AND z.i = f.i + 1))
    SELECT qid, id, tokens, cut AS truncated FROM f WHERE id IS NOT NULL"""


@query(_BUDGET)
def context_budget(spark, sf):
    """What a budget of 1024 tokens admits of each question's chunks, two known ids left out."""
    records, trust = _records(spark, sf)
    questions = _questions(spark, sf)
    offered = ask.offers(records.select("id", "vector"), records, trust, questions)
    known = questions.select("qid", F.explode(F.array(F.lit("v1"), F.lit("v3"))).alias("id"))
    return ask.retrieved(offered, records, 1024, known).select("qid", "id", "tokens", "truncated")


@query(_BUDGET)
def sql_context_budget(spark, sf):
    """The same through SQL: a table function over the offers, parted by question and ordered by place."""
    sql_functions.register(spark)
    records, trust = _records(spark, sf)
    offered = ask.offers(records.select("id", "vector"), records, trust, _questions(spark, sf)).select("qid", "place", "id")
    return spark.sql(
        """SELECT qid, id, tokens, truncated FROM fit_context(
             TABLE(SELECT o.qid, o.place, o.id, r.content FROM {offered} o JOIN {records} r USING (id) WHERE o.id NOT IN ('v1', 'v3')), 1024)""",
        offered=offered, records=records.select("id", "content"),
    )


def _admitted(spark, sf):
    records, trust = _records(spark, sf)
    asked = _questions(spark, sf)
    both = asked.select("qid", F.lit(0).alias("ordinal"), "question", "vector")
    later = asked.select("qid", F.lit(1).alias("ordinal"), F.concat(F.lit("again "), "question").alias("question"), F.reverse("vector").alias("vector"))
    offered = ask.offers(records.select("id", "vector"), records, trust, both.unionByName(later), min_score=0.0, relative=0.0)
    return records, offered, ask.retrieved(offered, records, 512)


@query()
def planned_asks(spark, sf):
    """Two planned queries for each question: each has its own budget and admits nothing that the first has (tested against a loop)."""
    _, offered, admitted = _admitted(spark, sf)
    return ask.merged(admitted, offered).select("qid", "ordinal", "id", "score", "vector_score", F.col("rank").cast("long").alias("rank"))


@query()
def tool_results(spark, sf):
    """Rows of local searches as a model sees them, with labels that records keep (tested against a loop)."""
    records, offered, admitted = _admitted(spark, sf)
    return ask.tool_result(ask.merged(admitted, offered), records).select("qid", "citation", "chunk_id", "location", "score")


@query("""WITH w AS (SELECT p_size AS qid, p_partkey AS place, 'https://x.example/' || (p_partkey % 40) AS url, p_name AS title, p_type AS snippet FROM part), f AS (SELECT qid, url, min(place) AS place FROM w GROUP BY ALL)
    SELECT qid, url, place, '[W' || row_number() OVER (PARTITION BY qid ORDER BY place) || ']' AS citation FROM f""")
def web_results(spark, sf):
    """Rows of web searches within a budget that holds them all: each address once, labelled in order."""
    p = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.col("p_size").alias("qid"), p.alias("place"), F.col("p_name").alias("title"), F.concat(F.lit("https://x.example/"), p % 40).alias("url"), F.col("p_type").alias("snippet"))
    first = rows.groupBy("qid", "url").agg(F.min_by(F.struct("place", "title", "snippet"), "place").alias("r")).select("qid", "url", "r.*")
    return ask.web_result(first, 1_000_000).select("qid", "url", "place", "citation")


@query("""WITH l AS (SELECT c_nationkey AS qid, 0 AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, 'c' || c_custkey AS key FROM customer), w AS (SELECT s_nationkey AS qid, 1 AS k, s_suppkey AS pos, 's' || s_suppkey AS key FROM supplier)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY k, pos, key) AS place, CASE k WHEN 0 THEN 'local' ELSE 'web' END AS kind, key FROM (SELECT * FROM l UNION ALL SELECT * FROM w)""")
def all_sources(spark, sf):
    """Local and then web sources of each conversation."""
    c = table(spark, sf, "customer")
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    local = c.select(F.col("c_nationkey").alias("qid"), rank.alias("rank"), F.lit("[S]").alias("citation"), F.concat(F.lit("c"), "c_custkey").alias("chunk_id"))
    web = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("qid"), F.col("s_suppkey").alias("place"), F.lit("[W]").alias("citation"), F.concat(F.lit("s"), "s_suppkey").alias("url"))
    return ask.sources(local, web).select("qid", F.col("place").cast("long").alias("place"), "kind", "key")


@query(f"""WITH {RECORDS_SQL}, r AS (SELECT id, 'own ' || number AS content FROM summaries UNION ALL SELECT 'lost' || doc_id, 'kept text' FROM documents)
    SELECT r.id, coalesce(s.content, r.content) AS content, coalesce(s.node_type, 'chunk') AS node_type, coalesce(s.file_path, 'somewhere') AS file_path FROM r LEFT JOIN summaries s USING (id)""")
def vector_rows(spark, sf):
    """Search results beside the index records that they name; lost ones keep their own text."""
    s = corpus.summaries(spark, sf)
    extra = {"qid": F.lit(1), "location": F.lit("somewhere"), "score": F.lit(0.5), "citation": F.lit("[S1]")}
    known = s.select(F.col("id").alias("chunk_id"), F.concat(F.lit("own "), "number").alias("content"))
    lost = table(spark, sf, "documents").select(F.concat(F.lit("lost"), "doc_id").alias("chunk_id"), F.lit("kept text").alias("content"))
    return ask.vector_rows(known.unionByName(lost).withColumns(extra), s).select("id", "content", "node_type", "file_path")


@query()
def ann_recall(spark, sf):
    """Share of the exact 10 nearest that an index of 64 lists finds at the probes that it chooses by itself."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    index = ann.build(v, 64)
    found = ann.search(index, q, 10).select("qid", "id", F.lit(1).alias("hit"))
    exact = retrieval.knn(v, q, 10).select("qid", "id")
    return exact.join(found, ["qid", "id"], "left").groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


# --- the block index

_TERMS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_]{{2,}}'), lambda x: lower(x))"
_CHUNKS = "ch AS (SELECT doc_id AS chunk_id, source AS doc_id, text FROM documents WHERE text IS NOT NULL)"
_FTS = f"""{_CHUNKS}, q AS (SELECT item_id AS qid, text AS question, unnest(list_distinct(({_TERMS.format('text')})[1:16])) AS term FROM benchmark), w AS (SELECT chunk_id, {_TERMS.format('text')} AS ts FROM ch), g AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM w),
    e AS (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM w), tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
    s AS (SELECT qid, chunk_id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), g GROUP BY ALL),
    x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s QUALIFY rank <= 24)"""


def _chunks(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text")


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


@query(f"WITH {_FTS} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM x")
def stored_term_search(spark, sf):
    """The same from the stored index of terms: blocks by their bounds, no text."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("source").alias("source_hash"), "text")
    found = corpus.kept_index(spark, sf, tx.terms, docs).search(_asked(spark, sf), classic.TERM_HITS, most=classic.MOST_TERMS)
    return found.select("qid", F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_CHANGED = "ch AS (SELECT doc_id AS chunk_id, source AS doc_id, CASE WHEN source = 'src1' THEN 'license ' || text ELSE text END AS text FROM documents WHERE text IS NOT NULL AND coalesce(source, '') <> 'src2')"


@query(f"WITH {_FTS.replace(_CHUNKS, _CHANGED)} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM x")
def stored_search_after_changes(spark, sf):
    """A search of a stored index after one source was replaced and another deleted: their postings only were written."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("source").alias("source_hash"), "text")
    index = TermIndex(spark, f"{staging.folder(spark)}/changed-{uuid.uuid4().hex}")
    index.build(docs)
    index.replace_sources(docs.where("source_hash = 'src1'").withColumn("text", F.concat(F.lit("license "), "text")))
    index.delete_sources(["src2"])
    found = index.search(_asked(spark, sf), classic.TERM_HITS, most=classic.MOST_TERMS)
    return found.select("qid", F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_FTS} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM x")
def term_search(spark, sf):
    return classic.term_search(_chunks(spark, sf), _asked(spark, sf)).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_RERANK = """f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM x JOIN ch USING (chunk_id) WHERE doc_id <> 'src1'), y AS (SELECT f.qid, chunk_id, 1.0 / (60 + place) + len(list_intersect(list_distinct({q}), {t})) / greatest(1, len(list_distinct({q})))::DOUBLE AS score FROM f JOIN benchmark b ON b.item_id = f.qid),
    z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM y QUALIFY rank <= 12)""".format(q=_TERMS.format("b.text"), t=_TERMS.format("f.text"))


@query(f"WITH {_FTS}, {_RERANK} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM z")
def classic_terms(spark, sf):
    """Questions in the mode of terms, in all sources but one: filtered after the choice, fused, reranked."""
    chunks = _chunks(spark, sf)
    docs = chunks.select("doc_id").distinct().where("doc_id <> 'src1'")
    out = classic.retrieve(_asked(spark, sf), chunks, None, "bm25", docs)
    return out.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_COSINE = """v AS (SELECT vec_id AS chunk_id, embedding FROM embeddings WHERE vec_id IN (SELECT chunk_id FROM ch)), qv AS (SELECT item_id AS qid, embedding AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
    cs AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) DESC, chunk_id) AS rank FROM qv, v QUALIFY rank <= 24)"""


@query(f"""WITH {_FTS}, {_COSINE}, u AS (SELECT qid, chunk_id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT qid, chunk_id, rank FROM cs UNION ALL SELECT x.qid, chunk_id, rank FROM x WHERE qid IN (SELECT qid FROM qv)) GROUP BY ALL),
    y AS (SELECT u.qid, chunk_id, rrf + len(list_intersect(list_distinct({_TERMS.format('b.text')}), {_TERMS.format('ch.text')})) / greatest(1, len(list_distinct({_TERMS.format('b.text')})))::DOUBLE AS score FROM u JOIN ch USING (chunk_id) JOIN benchmark b ON b.item_id = u.qid)
    SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM y QUALIFY rank <= 12""")
def classic_hybrid(spark, sf):
    """Questions in the mode of vectors and terms."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = _asked(spark, sf).join(vectors.withColumnRenamed("chunk_id", "qid"), "qid")
    return classic.retrieve(asked, _chunks(spark, sf), vectors).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"))


def _evidence(spark, sf):
    c = table(spark, sf, "conversations")
    name = F.concat_ws(":", "conv_id", "turn")
    blocks = c.select(name.alias("block_id"), F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 4).cast("int").alias("page_num"), F.col("turn").alias("reading_order"), F.col("role").alias("modality"), F.when(F.col("turn") % 5 != 3, F.col("text")).alias("content"))
    chunks = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t")).select(F.col("conv_id").alias("chunk_id"), F.transform(F.filter("t", lambda x: x % 3 == 0), lambda x: F.concat_ws(":", "conv_id", x)).alias("block_ids"))
    hits = c.select("conv_id").distinct().select((F.col("conv_id") % 5).alias("qid"), F.col("conv_id").alias("chunk_id"), F.lit(0.5).alias("score"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id")))
    docs = c.where("conv_id % 2 = 0").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("Talk "), "conv_id").alias("title")).distinct()
    return classic.evidence(ranked, chunks, blocks, docs, 2)


_EVIDENCE = """b AS (SELECT conv_id || ':' || turn AS block_id, conv_id, turn, turn // 4 AS page, role, CASE WHEN turn % 5 <> 3 THEN text END AS content FROM conversations), k AS (SELECT conv_id % 5 AS qid, conv_id, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id) AS rank FROM (SELECT DISTINCT conv_id FROM conversations)),
    o AS (SELECT k.qid, k.rank, b.conv_id, b.turn, b.page, row_number() OVER (PARTITION BY b.conv_id ORDER BY turn) - 1 AS ordinal FROM k JOIN b USING (conv_id) WHERE k.rank <= 2 AND b.turn % 3 = 0),
    e AS (SELECT o.qid, o.rank, o.ordinal, x.* FROM o JOIN b x ON x.conv_id = o.conv_id AND x.page = o.page AND x.turn BETWEEN o.turn - 1 AND o.turn + 1), f AS (SELECT *, row_number() OVER (PARTITION BY qid, block_id ORDER BY rank, ordinal, turn) AS n FROM e),
    p AS (SELECT *, row_number() OVER w AS place, sum(CASE WHEN coalesce(content, '') <> '' THEN 1 ELSE 0 END) OVER w AS filled FROM f WHERE n = 1 WINDOW w AS (PARTITION BY qid ORDER BY rank, ordinal, turn, block_id))"""


@query(f"WITH {_EVIDENCE} SELECT qid, place, block_id, CASE WHEN conv_id % 2 = 0 THEN 'Talk ' || conv_id ELSE conv_id::VARCHAR END AS title, coalesce(content, '') <> '' AND filled <= 8 AS cited FROM p")
def block_evidence(spark, sf):
    """Blocks of the first hits of questions with their neighbours, and which of them are cited."""
    return _evidence(spark, sf).select("qid", F.col("place").cast("long").alias("place"), "block_id", "title", "cited")


@query(f"""WITH {_EVIDENCE}, l AS (SELECT qid, string_agg('[C' || place || '] ' || CASE WHEN conv_id % 2 = 0 THEN 'Talk ' || conv_id ELSE conv_id::VARCHAR END || ', page ' || page || ', block ' || block_id || ', ' || role || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY place) AS context FROM p GROUP BY qid)
    SELECT qid, md5(context) AS context FROM l""")
def block_contexts(spark, sf):
    return classic.contexts(_evidence(spark, sf)).select("qid", F.md5("context").alias("context"))


@query("""SELECT conv_id AS qid, CASE WHEN conv_id % 3 = 0 THEN 'I could not find relevant local source blocks for that question.' ELSE 'Local generator unavailable. Most relevant retrieved evidence:' || chr(10) || '[C1] a: first ' || conv_id || chr(10) || '[C2] b: second' || chr(10) || '[C3] c: third' || chr(10) || '[C4] d: ' || repeat('y', 300) END AS answer FROM (SELECT DISTINCT conv_id FROM conversations)""")
def extractive_answers(spark, sf):
    """Answers without a model, from contexts."""
    text = F.concat(F.lit("[C1] a\nfirst "), "conv_id", F.lit("\nmore\n\n[C2] b\n second \n[C3] c\nthird\n[C4] d\n"), F.repeat(F.lit("y"), 400), F.lit("\n[C5] e\nfifth"))
    contexts = table(spark, sf, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("qid"), F.when(F.col("conv_id") % 3 == 0, " \n").otherwise(text).alias("context"))
    return classic.fallback_answers(contexts)


@query("""WITH b AS (SELECT conv_id, string_agg(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' ' ORDER BY turn) AS raw FROM conversations WHERE trim(text) <> '' GROUP BY ALL),
    g AS (SELECT regexp_replace(lower(raw), '[^\\p{L}\\p{N}_]+', ' ', 'g') AS k, count(*) AS n FROM b GROUP BY ALL) SELECT (SELECT count(*) FROM b) AS documents, (SELECT count(*) FROM b) AS chunks, (SELECT count(*) FROM g WHERE n > 1) AS duplicate_groups""")
def rebuilt_index(spark, sf):
    """Counts of an index of all conversations, a chunk each."""
    c = table(spark, sf, "conversations")
    blocks = c.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_num"), F.col("turn").alias("reading_order"), F.concat_ws(":", "conv_id", "turn").alias("block_id"), F.col("role").alias("modality"), F.col("text").alias("content"))
    return classic.rebuilt(blocks, lambda t: vec.embed(t, 16), 10_000_000)[2]
