"""The engine's registered queries: each applies operators to the test tables, with its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone import corpus
from lodestone.corpus import RECORDS_SQL, keywords_sql, table
from lodestone.functions import text as tx
from lodestone.functions import vectors as vec
from lodestone.functions import hints
from lodestone.operators import ann, blocks, documents, lifecycle, nearest, retrieval, trees
from lodestone.operators import records as rec
from lodestone.plans import context, sections
from lodestone.plans.registry import query
from lodestone.sources import files
from lodestone.sources.staging import stage
from lodestone.streaming import incremental

WS = r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+"
FLAT = rf"trim(regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g'))"


# --- scalar functions


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, (ceil(length(text) / 4.0) + 64)::BIGINT AS context_tokens, greatest(1, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')))::BIGINT AS words FROM documents")
def token_estimate(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.token_estimate(t).alias("tokens"), tx.context_estimate(t).alias("context_tokens"), tx.word_count(t).alias("words"))


@query(f"SELECT doc_id, CASE WHEN length({FLAT}) <= 360 THEN {FLAT} ELSE rtrim(substr({FLAT}, 1, 359)) || '...' END AS snippet FROM documents")
def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query(f"SELECT doc_id, len({keywords_sql('text')})::BIGINT AS n, md5(array_to_string(list_sort({keywords_sql('text')}), ' ')) AS words FROM documents")
def keywords(spark, sf):
    words = tx.keywords(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(words), " ")).alias("words"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]{2,}'))::BIGINT AS n, md5(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]{2,}'), lambda x: lower(x)), ' ')) AS terms FROM documents")
def index_terms(spark, sf):
    t = tx.terms(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("terms"))


@query("""SELECT doc_id, substr(sha1('doc' || chr(0) || doc_id::VARCHAR), 1, 24) AS doc_key, 'chunk_' || substr(sha1(source || chr(31) || doc_id::VARCHAR), 1, 20) AS old_key,
    sha256(text) AS content_hash FROM documents""")
def stable_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.stable_id("doc", F.col("doc_id")).alias("doc_key"), tx.prefixed_id("chunk", F.col("source"), F.col("doc_id")).alias("old_key"), tx.content_hash(F.col("text")).alias("content_hash"))


@query(f"""WITH {RECORDS_SQL} SELECT id, CASE WHEN page_start > 0 AND page_end > 0 AND page_start <> page_end THEN 'pages ' || page_start || '-' || page_end WHEN page_start > 0 THEN 'page ' || page_start ELSE '' END AS label,
    CASE WHEN page_start = page_end THEN page_start::VARCHAR ELSE page_start || '-' || page_end END AS page_range, source_pdf_name || ' :: ' || section_path AS locator FROM records""")
def page_labels(spark, sf):
    s, e = F.col("page_start"), F.col("page_end")
    return corpus.records(spark, sf).select("id", tx.page_label(s, e).alias("label"), tx.page_range(s, e).alias("page_range"), F.concat_ws(" :: ", "source_pdf_name", "section_path").alias("locator"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'https://x.example/' || page_id ELSE url END AS target, trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '-.') AS name FROM pages")
def url_normalize(spark, sf):
    wrapped = F.concat(F.lit("//search.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))
    link = F.when(F.col("page_id") % 3 == 0, wrapped).when(F.col("page_id") % 3 == 1, F.concat(F.lit("//x.example/"), "page_id")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", tx.unwrapped_url(link).alias("target"), tx.safe_component(F.col("url"), "page").alias("name"))


@query(r"""WITH v AS (SELECT doc_id, text, regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g') AS s, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)
    SELECT doc_id, length(s) >= 20 AND length(s) - length(replace(s, chr(65533), '')) <= 0.01 * length(s) AND length(regexp_replace(s, '[^\p{L}\p{N}]', '', 'g')) >= 0.35 * length(s) AS usable,
    len(list_filter(ls, lambda x: contains(x, '|') OR contains(x, chr(9)))) > 0 OR len(list_filter(ls, lambda x: len(regexp_extract_all(x, '[^ \t]+[ \t]{2,}[^ \t]+')) >= 2 OR (len(regexp_extract_all(x, '[0-9]+(?:\.[0-9]+)?')) >= 3 AND regexp_matches(x, '[ \t]{2,}')))) >= 3 AS table_like,
    len(list_filter(ls, lambda x: length(x) >= 6 AND ((len(regexp_extract_all(x, '[=+*/^_∑∫√≤≥≈≠-]')) >= 2 AND regexp_matches(x, '[A-Za-z0-9]')) OR regexp_matches(x, '\b[A-Za-z]\s*=\s*[^=]+')))) > 0 AS equation_like FROM v""")
def text_hints(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.is_usable_text(t).alias("usable"), tx.suggests_table(t).alias("table_like"), tx.suggests_equation(t).alias("equation_like"))


@query("""SELECT page_id, CASE WHEN c < 30 AND i > 0 THEN 'scanned' WHEN c >= 30 AND i > 0 THEN 'mixed' WHEN c >= 30 THEN 'digital' ELSE 'unknown' END AS kind, size FROM
    (SELECT page_id, length(html) % 60 AS c, page_id % 3 AS i, CASE WHEN length(html) >= 1024 THEN printf('%.1f KB', length(html) / 1024.0) ELSE length(html) || ' B' END AS size FROM pages)""")
def page_classes(spark, sf):
    n = F.length("html")
    return table(spark, sf, "pages").select("page_id", tx.page_class(n % 60, F.col("page_id") % 3).alias("kind"), tx.human_bytes(n).alias("size"))


_TAG_STOP = ", ".join(f"'{w}'" for w in tx.TAG_STOPWORDS)


@query(f"""WITH w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(source || ' ' || text), '[a-z][a-z0-9-]{{2,}}') AS ws FROM documents)),
    f AS (SELECT doc_id, w, min(i) AS i FROM w WHERE w NOT IN ({_TAG_STOP}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f)
    SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS tags FROM documents d LEFT JOIN (SELECT * FROM r WHERE k <= 12) r USING (doc_id) GROUP BY d.doc_id""")
def section_tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.tags(F.col("source"), F.col("text")), " ").alias("tags"))


# --- search, paging, sets


@query(f"WITH {RECORDS_SQL} SELECT id, length(content)::BIGINT AS char_count FROM records WHERE contains(lower(concat_ws(chr(10), id, content, title, section_path, summary, file_path, source_hash, source_pdf_name, source_pdf_path, doc_id, array_to_string(tags, ' '))), 'license')")
def record_search(spark, sf):
    return corpus.records(spark, sf).where(rec.matches("License")).select("id", F.length("content").cast("long").alias("char_count"))


@query(f"WITH {RECORDS_SQL} SELECT id, chunk_index, (SELECT count(*) FROM records) AS total FROM records ORDER BY id LIMIT 25 OFFSET 50")
def page_slice(spark, sf):
    return rec.page(corpus.records(spark, sf).select("id", "chunk_index"), [F.col("id")], 50, 25)


@query(f"""WITH {RECORDS_SQL} SELECT id, (SELECT count(*) FROM records) AS total FROM records ORDER BY coalesce(nullif(source_pdf_name, ''), file_path), section_path,
    CASE node_type WHEN 'document_summary' THEN 0 WHEN 'section_summary' THEN 1 WHEN 'chunk' THEN 2 ELSE 3 END, coalesce(chunk_index, -1), id LIMIT 200 OFFSET 300""")
def index_order(spark, sf):
    """A page of all records in index order."""
    return rec.page(corpus.records(spark, sf), rec.index_order(), 300, 200).select("id", "total")


@query(f"""WITH {RECORDS_SQL}, fresh AS (SELECT * REPLACE ('new ' || content AS content) FROM records WHERE source_hash = 'src3')
    SELECT id, source_hash, md5(content) AS content FROM (SELECT * FROM records WHERE source_hash <> 'src3' UNION ALL SELECT * FROM fresh)""")
def replace_source(spark, sf):
    old = corpus.records(spark, sf)
    new = old.where("source_hash = 'src3'").withColumn("content", F.concat(F.lit("new "), "content"))
    return rec.replace_by_key(old, new).select("id", "source_hash", F.md5("content").alias("content"))


@query(f"WITH {RECORDS_SQL} SELECT source_hash, count(*) AS remaining FROM records WHERE source_hash NOT IN ('src1', 'src2') AND file_path <> 'doc7.md' GROUP BY ALL")
def delete_source(spark, sf):
    kept = corpus.records(spark, sf).where(~rec.of_source(["src1", "src2"], ["doc7.md"]))
    return kept.groupBy("source_hash").agg(F.count(F.lit(1)).alias("remaining"))


@query("""SELECT d.doc_id, quality IS NOT NULL AND quality = 0 AS edited, md5(CASE WHEN quality = 0 THEN 'edited ' || d.doc_id ELSE text END) AS content
    FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) = 0""")
def override_apply(spark, sf):
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    edits = labels.where("quality = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("edited "), "doc_id").alias("content"))
    out = rec.apply_overrides(docs, edits, labels.where("toxic = 1").select(F.col("doc_id").alias("id")))
    return out.select(F.col("id").alias("doc_id"), "edited", F.md5("content").alias("content"))


@query("SELECT d.doc_id, vec_id IS NOT NULL AND d.doc_id % 3 <> 0 AS reused FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def content_hash_reuse(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    old = docs.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")
    changed = F.when(F.col("id") % 3 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))
    return rec.reuse_vectors(docs.withColumn("content", changed), old.withColumn("embedding_model", F.lit("hash")), "hash", 64).select(F.col("id").alias("doc_id"), "reused")


# --- vectors


_KNN = """WITH d AS (SELECT q.vec_id AS qid, v.vec_id AS id, 1 / (1 + list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS s
    FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) SELECT qid, id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM d) WHERE rank <= 80"""


@query(_KNN)
def knn_topk(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    return retrieval.knn(v, q).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_COSINE_KNN = """WITH d AS (SELECT q.vec_id AS qid, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
    SELECT qid, id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM d) WHERE rank <= 24"""


@query(_COSINE_KNN)
def cosine_topk(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    return retrieval.knn(v, q, 24, "cosine").select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")


@query(_KNN)
def knn_in_parts(spark, sf):
    """The same neighbours by parts with bounds: each query travels only to the parts that can hold one."""
    return nearest.knn(*_vectors(spark, sf), 80).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_COSINE_KNN)
def cosine_in_parts(spark, sf):
    return nearest.knn(*_vectors(spark, sf), 24, "cosine").select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def coded_recall(spark, sf):
    """Share of the exact 10 nearest that codes of 16 bytes find, for all vectors and for half of them, with the
    probed and all lists and by how much codes are smaller than vectors (tested against a bound of 0.9)."""
    v, _ = _vectors(spark, sf)
    out = []
    for name, part in (("all", v), ("half", v.where("id % 2 = 0"))):
        asked = part.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
        index = ann.build(part)
        index.lists = stage(index.lists, "lists")
        probes = ann.probes_for(index, asked, 10, 1, 0.95)
        coded = ann.coded(index)
        found = ann.search_coded(coded, asked, 10, probes).select("qid", "id", F.lit(1).alias("hit"))
        exact = retrieval.knn(part, asked, 10).select("qid", "id").join(found, ["qid", "id"], "left")
        sizes = coded.blocks.agg((F.sum(F.col("n") * 4 * v.select(F.max(F.size("vector"))).scalar()) / F.sum(F.length("codes"))).alias("f")).scalar()
        out.append(exact.agg((F.count("hit") / F.count(F.lit(1))).alias("recall")).select(F.lit(name).alias("part"), "recall", F.lit(probes).alias("probes"), F.lit(len(index.centroids)).alias("lists"), sizes.alias("smaller")))
    return out[0].unionByName(out[1])


@query("""WITH t AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM t)
    SELECT vec_id, round(v[1] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS first, round(v[16] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS last, 16::BIGINT AS dim FROM n""")
def mrl_truncate(spark, sf):
    v = vec.normalised(vec.fit_dimension(F.col("embedding"), 16))
    return table(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"), F.size("v").cast("long").alias("dim"))


@query()
def hash_embedding(spark, sf):
    """Vectors of all document texts by the deterministic embedder."""
    return table(spark, sf, "documents").select("doc_id", vec.embed(F.col("text")).alias("vector"))


@query()
def ann_topk(spark, sf):
    """Approximate nearest neighbours over an inverted file of all vectors."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return ann.search(ann.build(v), v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), k=10)


# --- lexical ranking and fusion

_BM25 = f"""w AS (SELECT doc_id AS id, {keywords_sql('text')} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
    q AS (SELECT item_id AS qid, unnest({keywords_sql('text')}) AS term FROM benchmark), t AS (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM w),
    f AS (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term),
    b AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / CASE WHEN mean <= 0 THEN 1 ELSE mean END))) AS bm25
          FROM t JOIN q USING (term) JOIN f USING (term), s GROUP BY qid, id)"""


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _keyword_index(spark, sf):
    docs = table(spark, sf, "documents")
    return corpus.kept_index(spark, sf, tx.keywords, docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_hash"), "text"))


@query(f"WITH {_BM25} SELECT qid, id, round(bm25, 6) AS bm25 FROM b")
def bm25_scores(spark, sf):
    """Scores of all documents with a keyword of a question, from the stored index of keywords."""
    return retrieval.bm25_of(_keyword_index(spark, sf).matches(_asked(spark, sf))).select("qid", "id", F.round("bm25", 6).alias("bm25"))


@query(f"""WITH {_BM25}, o AS (SELECT t.qid, t.id, count(*) AS hits FROM (SELECT DISTINCT qid, id, term FROM t JOIN q USING (term)) t GROUP BY ALL),
    x AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, id) AS rank FROM b), y AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id) AS rank FROM o)
    SELECT qid, id, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY ALL""")
def rrf_fuse(spark, sf):
    found = _keyword_index(spark, sf).matches(_asked(spark, sf))
    scored = retrieval.bm25_of(found).withColumn("bm25", F.round("bm25", 9))
    lists = [retrieval.ranked_wide(scored, "bm25"), retrieval.ranked_wide(retrieval.overlaps_of(found), "hits")]
    return retrieval.fuse(lists).select("qid", "id", F.round("rrf", 6).alias("rrf"))


@query(f"""WITH q AS (SELECT item_id AS qid, {keywords_sql('text')} AS qs FROM benchmark), d AS (SELECT doc_id AS id, {keywords_sql('text')} AS ws, {keywords_sql('source')} AS ts FROM documents),
    pairs AS (SELECT qid, id FROM (SELECT qid, unnest(qs) AS term FROM q) JOIN (SELECT id, unnest(ws) AS term FROM d) USING (term) GROUP BY ALL)
    SELECT qid, id, round(least(1.0, len(list_intersect(qs, ws)) / greatest(len(qs), 1) + 0.15 * len(list_intersect(qs, ts)) / greatest(len(qs), 1)), 6) AS overlap FROM pairs JOIN q USING (qid) JOIN d USING (id)""")
def lexical_overlap(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", tx.keywords(F.col("source")).alias("ts"))
    asked = _asked(spark, sf)
    hits = retrieval.overlaps_of(retrieval.matched(docs, F.col("text"), asked))
    terms = asked.select("qid", tx.keywords(F.col("question")).alias("qs"))
    n = F.greatest(F.size("qs"), F.lit(1))
    score = F.least(F.lit(1.0), F.col("hits") / n + 0.15 * F.size(F.array_intersect("qs", "ts")) / n)
    return hits.join(docs.select("id", "ts"), "id").join(terms, "qid").select("qid", "id", F.round(score, 6).alias("overlap"))


_POOL = f"""c AS (SELECT qid, id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS k FROM
        (SELECT q.vec_id AS qid, v.vec_id AS id, 1 / (1 + list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE k <= 80),
    p AS (SELECT c.*, coalesce(d.text, '') AS content, CASE e.label % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.1 END::DOUBLE AS weight FROM c JOIN embeddings e ON e.vec_id = c.id LEFT JOIN documents d ON d.doc_id = c.id),
    asked AS (SELECT vec_id AS qid, b.text AS question FROM embeddings JOIN benchmark b ON b.item_id = (vec_id // 20) % 40 WHERE vec_id % 20 = 0)"""


def _candidates(spark, sf):
    e = table(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = retrieval.knn(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector"))
    group = F.element_at(F.array(*map(F.lit, retrieval.SOURCE_WEIGHTS)), (F.col("label") % 4 + 1).cast("int"))
    info = e.select(F.col("vec_id").alias("id"), group.alias("source_group"))
    pool = near.join(info, "id").join(_texts(spark, sf), "id", "left").select("qid", "id", "score", F.coalesce("text", F.lit("")).alias("content"), "source_group")
    numbered = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), (F.floor(F.col("vec_id") / 20) % 40).alias("item_id"))
    return pool, numbered.join(table(spark, sf, "benchmark"), "item_id").select("qid", F.col("text").alias("question"))


_HYBRID = f"""{_POOL}, w AS (SELECT qid, id, {keywords_sql('content')} AS ws FROM p), s AS (SELECT qid, count(*) AS n, avg(len(ws)) AS mean FROM w GROUP BY qid),
    q AS (SELECT qid, unnest({keywords_sql('question')}) AS term FROM asked), t AS (SELECT qid, id, len(ws) AS dl, unnest(ws) AS term FROM w), f AS (SELECT qid, term, count(*) AS df FROM t GROUP BY ALL),
    b AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / CASE WHEN mean <= 0 THEN 1 ELSE mean END))) AS bm25 FROM t JOIN q USING (qid, term) JOIN f USING (qid, term) JOIN s USING (qid) GROUP BY ALL),
    r AS (SELECT qid, id, sum(1.0 / (60 + k)) AS rrf FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM p
          UNION ALL SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, id) FROM b WHERE bm25 > 0) GROUP BY ALL),
    m AS (SELECT p.qid, p.id, score, weight, CASE WHEN p.qid IN (SELECT qid FROM b WHERE bm25 > 0) THEN 0.8 * score + 0.2 * rrf / max(rrf) OVER o ELSE score END AS blend, greatest(0.5, 0.72 * max(score) OVER o) AS cutoff
          FROM p JOIN r USING (qid, id) WINDOW o AS (PARTITION BY p.qid)),
    h AS (SELECT qid, id, round(score, 4) AS vector_score, round(blend, 4) AS hybrid_score, round(blend * weight, 4) AS score, cutoff FROM m),
    g AS (SELECT qid, id, vector_score, hybrid_score, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vector_score DESC, id) AS rank FROM h WHERE vector_score >= cutoff)"""


@query(f"WITH {_HYBRID} SELECT * FROM g")
def hybrid_retrieve(spark, sf):
    pool, asked = _candidates(spark, sf)
    return retrieval.hybrid(pool, asked).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {RECORDS_SQL}, top AS (SELECT number % 997 AS qid, id, doc_id, node_type, row_number() OVER (PARTITION BY number % 997 ORDER BY number DESC, node_type, chunk_index, id) AS rank FROM records),
    e AS (SELECT qid, id, rank, 0 AS within FROM top WHERE node_type = 'chunk' UNION ALL SELECT qid, c.id, rank, row_number() OVER (PARTITION BY qid, top.id ORDER BY c.chunk_index, c.id) FROM top JOIN chunks c USING (doc_id) WHERE top.node_type = 'document_summary'),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY rank, within) AS k FROM e WHERE within <= 80) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank, within, id) AS place FROM o WHERE k = 1""")
def children_expand(spark, sf):
    """Rankings of the records of some documents each, summaries before chunks of later documents."""
    every = corpus.records(spark, sf)
    qid = F.col("number") % 997
    rank = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("number"), "node_type", "chunk_index", "id"))
    top = every.select(qid.alias("qid"), "id", rank.alias("rank"), F.lit(1.0).alias("vector_score"))
    return retrieval.expand_summaries(top, every).select("qid", "id", F.col("place").cast("long").alias("place"))


# --- aggregates, hierarchies, documents


@query(f"""WITH {RECORDS_SQL} SELECT source_hash AS source_key, arg_min(source_hash, id) AS source_hash, arg_min(source_pdf_name, id) AS source_pdf_name, arg_min(source_pdf_path, id) AS source_pdf_path, arg_min(file_path, id) AS file_path,
    count(*) AS record_count, count(*) FILTER (node_type = 'chunk') AS chunk_count, count(*) FILTER (node_type <> 'chunk') AS summary_count, count(*) FILTER (number % 3 <> 0) AS embedded_count, count(*) FILTER (number % 3 = 0) AS reused_count,
    sum(length(content))::BIGINT AS content_char_count, min(nullif(page_start, 0)) AS page_start, max(page_end) AS page_end FROM records GROUP BY records.source_hash""")
def manifest(spark, sf):
    return rec.manifest(corpus.records(spark, sf).withColumn("reused", F.col("number") % 3 == 0))


@query(f"""WITH {RECORDS_SQL} SELECT count(DISTINCT source_hash) AS documents, count(*) AS total_records, count(*) FILTER (number % 3 <> 0) AS embedded_records, count(*) FILTER (number % 3 = 0) AS reused_records FROM records""")
def manifest_totals(spark, sf):
    return rec.manifest_totals(manifest(spark, sf))


@query(rf"""SELECT 'dup_' || substr(sha1(regexp_replace(lower({FLAT}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), 1, 16) AS duplicate_group, count(*) AS members, min(doc_id) AS first_id FROM documents GROUP BY 1""")
def duplicate_groups(spark, sf):
    return blocks.duplicate_groups(_texts(spark, sf), F.col("text"))


_BLOCKS = "b AS (SELECT conv_id, conv_id || ':' || turn AS block_id, turn, role, text FROM conversations)"


def _blocks(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_num"), F.col("turn").alias("reading_order"), F.concat_ws(":", "conv_id", "turn").alias("block_id"), F.col("role").alias("modality"), F.col("text").alias("content"))


@query(f"WITH {_BLOCKS} SELECT x.block_id AS anchor_id, y.block_id, y.turn AS reading_order FROM b x JOIN b y ON x.conv_id = y.conv_id AND y.turn BETWEEN x.turn - 1 AND x.turn + 1")
def adjacent_blocks(spark, sf):
    b = _blocks(spark, sf)
    return blocks.neighbours(b, b, 1)


_EDGES = "e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS node FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


def _edges(spark, sf):
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    n, c, s = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    parts = [n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("node")), c.select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("node"))]
    return parts[0].unionByName(parts[1]).unionByName(s.select(name("n", "s_nationkey").alias("parent"), name("s", "s_suppkey").alias("node")))


_CLOSURE = f"WITH RECURSIVE {_EDGES}, d AS (SELECT parent AS ancestor, node, 1 AS depth FROM e UNION ALL SELECT d.ancestor, e.node, depth + 1 FROM d JOIN e ON d.node = e.parent) SELECT ancestor, node, depth FROM d"


@query(_CLOSURE)
def hierarchy_descendants(spark, sf):
    return rec.descendants(_edges(spark, sf))


@query(_CLOSURE)
def hierarchy_pairs(spark, sf):
    """The same pairs from interval labels: each interval as aligned blocks, met by equality."""
    return trees.pairs(trees.labels(_edges(spark, sf)))


@query(f"WITH RECURSIVE {_EDGES}, d AS (SELECT node, parent AS up, 1 AS depth FROM e UNION ALL SELECT d.node, e.parent, depth + 1 FROM d JOIN e ON d.up = e.node), n AS (SELECT node FROM e UNION SELECT parent FROM e), b AS (SELECT up AS node, count(*) AS below FROM d GROUP BY ALL) SELECT node, coalesce((SELECT max(depth) FROM d WHERE d.node = n.node), 0) AS depth, coalesce(below, 0) AS below FROM n LEFT JOIN b USING (node)")
def hierarchy_labels(spark, sf):
    """Depth of every node and how many are below it, as the difference of its labels."""
    return trees.labels(_edges(spark, sf)).rows.select("node", "depth", (F.col("last") - F.col("pre")).alias("below"))


@query(f"WITH RECURSIVE {_EDGES}, d AS (SELECT parent AS ancestor, node, 1 AS depth FROM e UNION ALL SELECT d.ancestor, e.node, depth + 1 FROM d JOIN e ON d.node = e.parent) SELECT ancestor AS node, count(*) FILTER (depth = 1) AS child_count, count(*) AS descendant_count FROM d GROUP BY ALL")
def hierarchy_counts(spark, sf):
    return rec.node_counts(_edges(spark, sf))


@query(f"WITH {RECORDS_SQL} SELECT id, node_type FROM records WHERE node_type = 'document_summary'")
def top_summaries(spark, sf):
    return rec.top_rows(corpus.records(spark, sf)).select("id", "node_type")


_TRUST = """t AS (SELECT source, CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'stale' ELSE '' END AS review_status, CASE WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN '2020-01-31' ELSE '' END AS expires_at FROM (SELECT DISTINCT source FROM documents)),
    warned AS (SELECT source, list_filter([CASE WHEN review_status = '' THEN 'unreviewed_source' END, CASE WHEN review_status = 'rejected' THEN 'rejected_source' END, CASE WHEN review_status = 'stale' THEN 'marked_stale' END, CASE WHEN expires_at <> '' THEN 'review_expired' END], lambda x: x IS NOT NULL) AS ws FROM t)"""


def _trust(spark, sf):
    n = F.substring("source", 4, 10).cast("int")
    status = F.element_at(F.array(F.lit("approved"), F.lit("rejected"), F.lit("stale"), F.lit("")), n % 4 + 1)
    return table(spark, sf, "documents").select("source").distinct().select("source", status.alias("review_status"), F.when(n % 3 == 0, "2020-01-31").otherwise("").alias("expires_at"))


@query(f"WITH {_TRUST} SELECT source, array_to_string(ws, ' ') AS warnings FROM warned")
def trust_warnings(spark, sf):
    return _trust(spark, sf).select("source", F.array_join(documents.trust_warnings(F.current_timestamp()), " ").alias("warnings"))


@query(f"""WITH {_TRUST}, d AS (SELECT doc_id, length(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS n, length(text) - length(replace(text, '|', '')) AS bars, CASE WHEN doc_id % 5 = 0 THEN 'queued' ELSE 'indexed' END AS status, doc_id % 7 AS chunks, source FROM documents),
    w AS (SELECT doc_id, bars, list_concat(list_filter([CASE WHEN n < 500 THEN 'low_extracted_text' END, CASE WHEN status <> 'indexed' THEN 'not_indexed' END, CASE WHEN chunks <= 0 THEN 'no_chunks' END], lambda x: x IS NOT NULL), ws) AS ws FROM d JOIN warned USING (source))
    SELECT doc_id, bars::BIGINT AS table_markers, array_to_string(ws, ' ') AS warnings, CASE WHEN len(ws) = 0 THEN 'ready' WHEN list_has_any(ws, ['not_indexed', 'no_chunks', 'rejected_source']) THEN 'not_ready' ELSE 'review' END AS label FROM w""")
def document_quality(spark, sf):
    warned = _trust(spark, sf).select("source", documents.trust_warnings(F.current_timestamp()).alias("trust"))
    d = table(spark, sf, "documents").withColumns({"status": F.when(F.col("doc_id") % 5 == 0, "queued").otherwise("indexed"), "chunk_count": F.col("doc_id") % 7} | documents.markdown_counts(F.col("text")))
    w = d.join(warned, "source").withColumn("w", documents.quality_warnings(F.col("trust")))
    return w.select("doc_id", "table_markers", F.array_join("w", " ").alias("warnings"), documents.quality_label(F.col("w")).alias("label"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id")
def registry_latest(spark, sf):
    return documents.latest_state(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["ts", "event_type"]).select("user_id", F.col("event_type").alias("status"), "ts")


@query(f"""WITH s AS (SELECT {documents.STATES} AS s), r AS (SELECT user_id AS job_id, min(event_id % 9 + 1) AS rank, count(*) AS uploads FROM events GROUP BY user_id)
    SELECT job_id, rank::INT AS rank, uploads, s[rank] AS resume_at FROM r, s""")
def recovery_jobs(spark, sf):
    e = table(spark, sf, "events")
    status = F.element_at(F.array(*map(F.lit, documents.STATES)), (F.col("event_id") % 9 + 1).cast("int"))
    return documents.recovery_jobs(e.select(F.col("user_id").alias("job_id"), status.alias("status")))


@query("SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) = 1 AS active FROM documents")
def supersede(spark, sf):
    d = table(spark, sf, "documents").withColumn("path", tx.content_hash(F.col("text")))
    return documents.supersede(d, "path", ["doc_id"], "doc_id").select("doc_id", "active")


@query("""SELECT o_custkey AS key, CASE WHEN c.c_custkey IS NOT NULL THEN 'registry' WHEN s.s_suppkey IS NOT NULL THEN 'source_map' ELSE 'table' END AS found_in FROM (SELECT DISTINCT o_custkey FROM orders) o
    LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) c ON c_custkey = o_custkey LEFT JOIN supplier s ON s_suppkey = o_custkey LEFT JOIN part p ON p_partkey = o_custkey WHERE coalesce(c_custkey, s_suppkey, p_partkey) IS NOT NULL""")
def duplicate_cascade(spark, sf):
    key = lambda t, c: table(spark, sf, t).select(F.col(c).alias("key"))
    stores = [("registry", table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("key"))), ("source_map", key("supplier", "s_suppkey")), ("table", key("part", "p_partkey"))]
    return documents.first_match(key("orders", "o_custkey"), "key", stores)


_ANSWERS = "a AS (SELECT conv_id || ':' || turn AS answer_id, turn, text || ' [S' || (turn % 4 + 1) || ']. Again [W1].' AS text FROM conversations WHERE role = 'assistant')"


def _answers(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("answer_id"), F.concat("text", F.lit(" [S"), F.col("turn") % 4 + 1, F.lit("]. Again [W1].")).alias("text"))


@query(rf"WITH {_ANSWERS} SELECT answer_id, array_to_string(regexp_extract_all(text, '\[[SW][0-9]+\]'), ' ') AS labels FROM a")
def citation_labels(spark, sf):
    return _answers(spark, sf).select("answer_id", F.array_join(tx.citation_labels(F.col("text")), " ").alias("labels"))


@query(rf"WITH {_ANSWERS}, l AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(text, '\[[SW][0-9]+\]')) AS label FROM a) SELECT answer_id, label FROM l WHERE label NOT IN ('[S1]', '[S2]')")
def unknown_citations(spark, sf):
    a = _answers(spark, sf)
    valid = a.select("answer_id", F.explode(F.array(F.lit("[S1]"), F.lit("[S2]"))).alias("label"))
    return documents.unknown_citations(a, valid)


@query(rf"""WITH c AS (SELECT conv_id, turn, text FROM conversations), a AS (SELECT conv_id || ':' || turn AS answer_id, 'Indeed ' || regexp_replace(text, '[^A-Za-z ]+', '', 'g') || ' [S1]' AS claim, conv_id, turn FROM c WHERE turn > 0 AND text IS NOT NULL),
    s AS (SELECT a.*, lower(CASE WHEN a.turn % 2 = 0 THEN regexp_replace(p.text, '[^A-Za-z ]+', '', 'g') || ' indeed ' || claim ELSE regexp_replace(p.text, '[^A-Za-z ]+', '', 'g') END) AS source FROM a JOIN c p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1 AND p.text IS NOT NULL),
    k AS (SELECT answer_id, {keywords_sql("claim")} AS ws, source FROM s)
    SELECT answer_id, round(len(list_filter(ws, lambda w: contains(source, w))) / len(ws), 6) AS share FROM k WHERE len(ws) >= 4 AND len(list_filter(ws, lambda w: contains(source, w))) < 0.25 * len(ws)""")
def weak_claims(spark, sf):
    """Claims that the turn before supports too little; every other claim is part of its source."""
    letters = lambda c: F.regexp_replace(c, "[^A-Za-z ]+", "")
    c = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", letters(F.col("text")).alias("text"))
    claim = F.concat(F.lit("Indeed "), "text", F.lit(" [S1]"))
    answers = c.where("turn > 0").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("answer_id"), claim.alias("claim"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), "text")
    body = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" indeed "), "claim")).otherwise(F.col("text"))
    sources = answers.join(before, ["conv_id", "turn"]).select("answer_id", F.lit("[S1]").alias("label"), body.alias("content"))
    weak = documents.weak_claims(answers.select("answer_id", F.col("claim").alias("text")), sources)
    return weak.select("answer_id", F.round("share", 6).alias("share"))


# --- sections, sources, streams


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>', 1)) AS level, unnest(range(0, len(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>', 1)))) AS ord FROM pages),
    x AS (SELECT page_id AS doc_id, ord::INT AS ord, level::INT AS level FROM h)
    SELECT a.doc_id, a.ord, a.level, coalesce((SELECT max(b.ord) FROM x b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level), -1) AS parent_ord,
    coalesce((SELECT min(b.ord) FROM x b WHERE b.doc_id = a.doc_id AND b.ord > a.ord AND b.level <= a.level), -1) AS next_ord FROM x a""")
def section_tree(spark, sf):
    levels = F.regexp_extract_all("html", F.lit("(?is)<h([1-6])[^>]*>"), F.lit(1))
    heads = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(levels).alias("ord", "level")).withColumn("level", F.col("level").cast("int"))
    return sections.section_tree(heads).drop("has_children").withColumn("next_ord", F.coalesce("next_ord", F.lit(-1)))


@query(f"WITH {RECORDS_SQL} SELECT id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1)::BIGINT AS number FROM chunks")
def chunk_index(spark, sf):
    return corpus.chunks(spark, sf).select("id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1).cast("long").alias("number"))


@query("""WITH s AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations WHERE role = 'user')
    SELECT s.conv_id, s.turn AS page_start, count(*) AS pages, md5(string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn)) AS body FROM s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn >= s.turn AND (nxt IS NULL OR c.turn < nxt) GROUP BY ALL""")
def page_range_join(spark, sf):
    c = table(spark, sf, "conversations")
    starts = c.where("role = 'user'").select("conv_id", F.col("turn").alias("page_start"), F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("nxt"))
    met = starts.join(c, (starts["conv_id"] == c["conv_id"]) & (c["turn"] >= starts["page_start"]) & (F.col("nxt").isNull() | (c["turn"] < F.col("nxt")))).select(starts["conv_id"], "page_start", "turn", "text")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return met.groupBy("conv_id", "page_start").agg(F.count(F.lit(1)).alias("pages"), F.md5(body).alias("body"))


@query("SELECT page_id AS doc_id, 1 AS page_no, html AS text FROM pages")
def sidecar_round_trip(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("html").alias("text"))
    return files.from_sidecar(files.to_sidecar(pages))


@query("SELECT event_type AS phase, event_id AS done, user_id AS total, 'rows' AS unit, NULL::DOUBLE AS rate_per_min, NULL::DOUBLE AS eta_seconds FROM events")
def progress_parse(spark, sf):
    body = F.to_json(F.struct(F.col("event_type").alias("phase"), F.col("event_id").alias("done"), F.col("user_id").alias("total"), F.lit("rows").alias("unit")))
    return incremental.progress_events(table(spark, sf, "events").select(F.concat(F.lit(incremental.PROGRESS_MARK), body).alias("value")))


# --- hints, lifecycle, context


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents), t AS (SELECT doc_id, raw, trim(raw) AS x FROM l WHERE trim(raw) <> ''),
    c AS (SELECT doc_id, raw, regexp_matches(x, '(?i)^(def|class|import|from|return|async\s+def|await)\b') OR regexp_matches(x, '(?i)^(for|while|if|elif|else|try|except|finally|with)\b.*:') OR regexp_matches(x, '(?i)^(const|let|var|function|return|export|import)\b')
        OR regexp_matches(x, '(?i)^(public|private|protected|static|class|interface|void|int|double|float|bool|string)\b') OR regexp_matches(x, '(?i)^#\s*include\b') OR regexp_matches(x, '(?i)^(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b')
        OR regexp_matches(x, '(?i)^(fn|let|mut|impl|pub|use|struct|enum|trait)\b') OR (regexp_matches(x, '[{};]$') AND regexp_matches(x, '[A-Za-z_]')) OR regexp_matches(x, '(->|=>|::|:=|==|!=|&&|\|\|)') OR regexp_matches(x, '^</?[A-Za-z][A-Za-z0-9-]*(\s+[^>]*)?>') AS code,
        regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_.$\[\]]*\s*=\s*[^=]') AS assigns FROM t),
    n AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (code) AS code, count(*) FILTER (regexp_matches(raw, '^(    |\t)') AND (code OR assigns)) AS indented FROM c GROUP BY doc_id)
    SELECT d.doc_id, regexp_matches(text, '(?m)^\s*(```|~~~)') OR regexp_matches(text, '(?m)^\s*(>>>|\.\.\.|In \[\d+\]:|\$ )') OR coalesce(code >= 3 OR (code >= 2 AND lines <= 12) OR indented >= 2, false) AS code_like FROM documents d LEFT JOIN n USING (doc_id)""")
def code_hint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hints.suggests_code(F.col("text")).alias("code_like"))


@query("""WITH n AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS status, min(ts) AS recorded_at FROM events GROUP BY user_id)
    SELECT user_id AS job_id, status FROM n WHERE status NOT IN ('purchase', 'click')""")
def ledger_pending(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "failed").otherwise(F.col("event_type"))
    log = e.select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").alias("recorded_at"), "event_type")
    last = log.groupBy("job_id").agg(F.max(F.struct("recorded_at", "event_type", "status")).alias("l")).select("job_id", "l.status", "l.recorded_at")
    return lifecycle.pending(last).select("job_id", "status")


@query("""SELECT o_orderkey AS key, CASE WHEN l.n IS NULL THEN o_orderstatus ELSE 'L' END AS status, coalesce(l.n, 0) AS n FROM orders FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY ALL) l ON l_orderkey = o_orderkey""")
def upsert_rows(spark, sf):
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.lit(0).cast("long").alias("n"))
    new = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.lit("L"))
    return lifecycle.upsert(old, new, ["key"])


@query("""SELECT 'documents' AS name, count(*) AS n FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0)
    UNION ALL SELECT 'labels', count(*) FROM labels JOIN documents USING (doc_id) WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0)""")
def cascade_delete(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    labels = table(spark, sf, "labels").join(docs, "doc_id")
    left = lifecycle.cascade({"documents": docs, "labels": labels}, labels.where("toxic = 1 AND quality = 0"), "source")
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in left.items()]
    return counts[0].unionByName(counts[1])


@query(r"""WITH t AS (SELECT doc_id, 'see [[image:img_' || (doc_id % 50) || ']] and [[image:img_' || (doc_id % 7) || ']] or [[image:img_' || (doc_id % 50) || ']]' AS text FROM documents),
    m AS (SELECT doc_id, unnest(ids) AS asset, unnest(range(0, len(ids))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\[\[image:([A-Za-z0-9_.-]+)\]\]', 1) AS ids FROM t)),
    f AS (SELECT doc_id, asset, min(i) AS i FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM f)
    SELECT doc_id AS id, place, asset AS asset_id FROM r WHERE CAST(substr(asset, 5) AS INT) < 40""")
def asset_markers(spark, sf):
    d = F.col("doc_id")
    mark = lambda n: F.concat(F.lit("[[image:img_"), d % n, F.lit("]]"))
    texts = table(spark, sf, "documents").select(d.alias("id"), F.concat(F.lit("see "), mark(50), F.lit(" and "), mark(7), F.lit(" or "), mark(50)).alias("content"))
    assets = spark.range(40).select(F.concat(F.lit("img_"), "id").alias("asset_id"))
    return lifecycle.assets_in(texts, assets).select("id", F.col("place").cast("long").alias("place"), "asset_id")


@query("""WITH a AS (SELECT conv_id, turn AS seq, role AS key FROM conversations), f AS (SELECT conv_id, key, min(seq) AS s FROM a GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, key) AS k FROM f)
    SELECT conv_id, seq, key, '[S' || k || ']' AS label FROM a JOIN n USING (conv_id, key)""")
def citation_numbers(spark, sf):
    return context.cited(table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("role").alias("key"))).select("conv_id", "seq", "key", "label")


@query("SELECT conv_id, sum(64 + ceil(length(role) / 4.0)::BIGINT + ceil(length(text) / 4.0)::BIGINT)::BIGINT AS tokens, greatest(0, greatest(1, floor(8192 * 0.6)) - sum(64 + ceil(length(role) / 4.0)::BIGINT + ceil(length(text) / 4.0)::BIGINT))::BIGINT AS budget FROM conversations GROUP BY ALL")
def prompt_budget(spark, sf):
    used = context.prompt_tokens(table(spark, sf, "conversations").select("conv_id", "role", F.col("text").alias("content")))
    return used.withColumn("budget", context.context_budget(F.lit(8192), F.lit(0.9), F.col("tokens")))


@query(f"WITH {RECORDS_SQL} SELECT id FROM summaries WHERE doc_id IN (SELECT doc_id FROM records WHERE contains(lower(concat_ws(chr(10), id, content, title, section_path, summary, file_path, source_hash, source_pdf_name, source_pdf_path, doc_id, array_to_string(tags, ' '))), 'license'))")
def summary_search(spark, sf):
    return rec.summaries_matching(corpus.records(spark, sf), "license").select("id")


@query("""SELECT coalesce(c_custkey, s_suppkey) AS source_hash, coalesce(c_name, s_name) AS filename, CASE WHEN coalesce(o.n, 0) > 0 THEN 'indexed' WHEN c_custkey IS NULL THEN 'ingested' ELSE c_mktsegment END AS status, coalesce(o.n, 0) AS chunk_count,
    CASE WHEN p_partkey IS NULL THEN 'ungrouped' ELSE p_brand END AS source_group FROM customer FULL JOIN supplier ON c_custkey = s_suppkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) o ON o_custkey = coalesce(c_custkey, s_suppkey) LEFT JOIN part ON p_partkey = coalesce(c_custkey, s_suppkey)""")
def document_list(spark, sf):
    t = lambda name: table(spark, sf, name)
    key = lambda c: F.col(c).alias("source_hash")
    registry = t("customer").select(key("c_custkey"), F.col("c_name").alias("filename"), F.col("c_mktsegment").alias("status"))
    manifests = t("orders").groupBy(key("o_custkey")).agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.listing(registry, t("supplier").select(key("s_suppkey"), F.col("s_name").alias("filename")), manifests, t("part").select(key("p_partkey"), F.col("p_brand").alias("source_group")))
