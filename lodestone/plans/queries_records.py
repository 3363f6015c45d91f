"""Registered queries over index records, hierarchies, manifests, overrides, jobs and trust."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone import corpus
from lodestone.corpus import RECORDS_SQL, table
from lodestone.functions import text as tx
from lodestone.functions import tokens
from lodestone.functions import vectors as vec
from lodestone.operators import documents, jobs, lifecycle, retrieval
from lodestone.operators import records as rec
from lodestone.plans.registry import query
from lodestone.streaming import incremental

_ORDER = "coalesce(nullif(source_pdf_name, ''), file_path), section_path, CASE node_type WHEN 'document_summary' THEN 0 WHEN 'section_summary' THEN 1 WHEN 'chunk' THEN 2 ELSE 3 END, coalesce(chunk_index, -1), id"


def _doc_key(n: int) -> str:
    return hashlib.sha1(f"doc\0{n}".encode()).hexdigest()[:24]


@query(f"""WITH {RECORDS_SQL}, c AS (SELECT * FROM records WHERE doc_id = '{_doc_key(7)}' AND id <> '{_doc_key(7)}')
    SELECT id, chunk_index, CASE WHEN array_length(string_split(section_path, ' > ')) > 1 THEN 1 ELSE 1 END::INT AS node_level, (SELECT count(*) FROM c) AS total FROM c ORDER BY {_ORDER} LIMIT 5 OFFSET 0""")
def child_list(spark, sf):
    """The first page of what lies below the summary of document 7."""
    return rec.child_page(corpus.records(spark, sf), _doc_key(7), 0, 5).select("id", "chunk_index", F.col("node_level").cast("int").alias("node_level"), "total")


@query(f"""WITH {RECORDS_SQL} SELECT s.id, count(c.id) AS child_count, 0::BIGINT AS summary_count, count(c.id) AS detail_count FROM summaries s LEFT JOIN chunks c USING (doc_id) GROUP BY s.id""")
def hierarchy_metadata(spark, sf):
    return rec.hierarchy(corpus.records(spark, sf))


_PATHS = "p AS (SELECT c_custkey AS id, c_mktsegment || ' > ' || (c_nationkey % 5) || ' > ' || c_custkey AS path, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_mktsegment || '>' || (c_nationkey % 5) ELSE 'elsewhere' END AS above FROM customer)"


@query(f"WITH {_PATHS} SELECT id, CASE id % 3 WHEN 0 THEN 2 ELSE 1 END::INT AS level FROM p")
def node_levels(spark, sf):
    c, n = F.col("c_custkey"), F.col("c_nationkey") % 5
    path = F.concat_ws(" > ", "c_mktsegment", n, c)
    above = F.when(c % 3 == 0, F.col("c_mktsegment")).when(c % 3 == 1, F.concat("c_mktsegment", F.lit(">"), n)).otherwise("elsewhere")
    return table(spark, sf, "customer").select(c.alias("id"), rec.node_level(path, above).cast("int").alias("level"))


@query("""WITH m AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL)
    SELECT c_custkey AS id, coalesce(a.n, b.n, d.n) AS chunk_count FROM customer LEFT JOIN m a ON a.k = c_custkey * 7 LEFT JOIN m b ON b.k = c_custkey * 3 LEFT JOIN m d ON d.k = c_custkey""")
def manifest_stats(spark, sf):
    """Counts of the manifest entry that the first of three keys names."""
    entries = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("source_key")).agg(F.count(F.lit(1)).alias("chunk_count"))
    c = F.col("c_custkey")
    docs = table(spark, sf, "customer").select(c.alias("id"), (c * 7).alias("k1"), (c * 3).alias("k2"), c.alias("k3"))
    return rec.manifest_stats(docs, entries, ["k1", "k2", "k3"], ["chunk_count"]).select("id", "chunk_count")


@query("SELECT coalesce(nullif(arg_min(CASE WHEN vec_id % 2 = 0 THEN '' ELSE 'hash' END, vec_id), ''), 'nomic-embed-text') AS embedding_model, 64::BIGINT AS embedding_dim FROM embeddings")
def table_metadata(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, "").otherwise("hash").alias("embedding_model"), F.size("embedding").cast("long").alias("embedding_dim"))
    return rec.table_metadata(v)


@query("""WITH a AS (SELECT source AS source_hash, min(doc_id) AS seq FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), b AS (SELECT source AS source_hash, min(doc_id) AS seq FROM documents GROUP BY ALL),
    f AS (SELECT source_hash, min((l, seq)) AS pos FROM (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY source_hash) SELECT source_hash, row_number() OVER (ORDER BY pos, source_hash) AS place FROM f""")
def known_sources(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("source_hash"), F.col("doc_id").alias("seq"))
    return rec.known_sources([d.where("seq % 2 = 0"), d]).select("source_hash", F.col("place").cast("long").alias("place"))


@query("""WITH e AS (SELECT doc_id AS record_id, 'old ' || doc_id AS content FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'new ' || doc_id FROM documents WHERE doc_id % 3 = 0)
    SELECT record_id, content, 'edit' AS kind FROM e UNION ALL SELECT doc_id, NULL, 'deletion' FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0""")
def override_edits(spark, sf):
    """Overrides after edits: they replace older edits and take deletions back."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"))
    edit = lambda word, n: d.where(f"record_id % {n} = 0").withColumn("content", F.concat(F.lit(word), "record_id"))
    edits, deletions = rec.with_edit(edit("old ", 4), d.where("record_id % 5 = 0"), edit("new ", 3))
    return edits.withColumn("kind", F.lit("edit")).unionByName(deletions.select("record_id", F.lit(None).cast("string").alias("content"), F.lit("deletion").alias("kind")))


@query("""SELECT doc_id AS record_id, 'edit' AS kind FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0 AND source <> 'src1'
    UNION ALL SELECT doc_id, 'deletion' FROM documents WHERE (doc_id % 5 = 0 OR doc_id % 3 = 0) AND source <> 'src1'""")
def override_deletions(spark, sf):
    """Overrides after deletions, without those of one source."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("source_hash"))
    edits, deletions = rec.with_deletions(d.where("record_id % 4 = 0"), d.where("record_id % 5 = 0"), d.where("record_id % 3 = 0"))
    gone = d.where("source_hash = 'src1'")
    kinds = [rec.without_sources(x, gone).select("record_id", F.lit(kind).alias("kind")) for x, kind in ((edits, "edit"), (deletions, "deletion"))]
    return kinds[0].unionByName(kinds[1])


@query("SELECT doc_id AS id, CASE WHEN doc_id = 11 THEN 'brand new text' ELSE text END AS content, CASE WHEN doc_id = 11 THEN 'hash' ELSE 'old' END AS embedding_model, CASE WHEN doc_id = 11 THEN 16 ELSE 0 END::BIGINT AS dim FROM documents")
def row_edit(spark, sf):
    """One record's text changed and embedded anew."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array().cast("array<float>").alias("vector"), F.lit("old").alias("embedding_model"), F.lit(0).cast("long").alias("embedding_dim"))
    out = rec.changed_row(d, 11, "brand new text", lambda t: vec.embed(t, 16), "hash", 16)
    return out.select("id", "content", "embedding_model", F.size("vector").cast("long").alias("dim"))


@query("SELECT count(*) FILTER (doc_id % 6 = 0) AS deleted, count(*) FILTER (doc_id % 6 <> 0) AS remaining FROM documents")
def delete_counts(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    left = rec.delete_ids(d, d.where("id % 6 = 0"))
    every = d.agg(F.count(F.lit(1)).alias("n")).scalar()
    return left.agg(F.count(F.lit(1)).alias("remaining")).select((every - F.col("remaining")).alias("deleted"), "remaining")


# --- jobs

_JOBS = """j AS (SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, o_orderpriority AS phase, CASE WHEN o_orderkey % 7 = 0 THEN 'Disk Full' ELSE '' END AS error,
    ['File-' || o_custkey || '.pdf', 'b.pdf'] AS filenames, o_orderdate AS created_at FROM orders)"""


def _jobs(spark, sf):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "completed", "failed"))), (k % 4 + 1).cast("int"))
    names = F.array(F.concat(F.lit("File-"), "o_custkey", F.lit(".pdf")), F.lit("b.pdf"))
    return table(spark, sf, "orders").select(k.cast("string").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("phase"), F.when(k % 7 == 0, "Disk Full").otherwise("").alias("error"), names.alias("filenames"), F.col("o_orderdate").alias("created_at"))


@query(f"""WITH {_JOBS}, f AS (SELECT * FROM j WHERE contains(lower(error), 'disk') OR contains(lower(phase), 'disk') OR contains(lower(array_to_string(filenames, ', ')), 'disk'))
    SELECT id, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM j WHERE status IN ('queued', 'running')) AS active_count FROM f ORDER BY created_at DESC, id LIMIT 10 OFFSET 20""")
def job_list(spark, sf):
    return jobs.job_page(_jobs(spark, sf), " disk ", 20, 10).select("id", "total", "active_count")


@query(f"WITH {_JOBS} SELECT count(*) AS jobs, count(*) FILTER (status IN ('queued', 'running')) AS active, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, 0::BIGINT AS cancelled, 0::BIGINT AS interrupted FROM j")
def queue_counts(spark, sf):
    return jobs.queue_counts(_jobs(spark, sf))


@query(f"WITH {_JOBS} SELECT id, row_number() OVER (ORDER BY CASE WHEN phase = '1-URGENT' THEN 0 ELSE 1 END, created_at, id) AS place, phase <> '1-URGENT' AS writes FROM j WHERE status = 'queued' ORDER BY place LIMIT 100")
def next_jobs(spark, sf):
    j = _jobs(spark, sf).withColumn("kind", F.when(F.col("phase") == "1-URGENT", "query").otherwise("ingest"))
    return jobs.next_jobs(j).select("id", F.col("place").cast("long").alias("place"), "writes")


@query("""WITH e AS (SELECT c_custkey AS hash, c_custkey % 5 AS job_id, CASE c_custkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'ingested' ELSE 'ingesting' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 'indexed' END AS previous FROM customer),
    v AS (SELECT s_suppkey AS hash, s_suppkey % 2 + s_suppkey % 5 - s_suppkey % 2 AS job_id, CASE s_suppkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'interrupted' ELSE 'indexed' END AS status FROM supplier WHERE s_suppkey % 10 <> 3)
    SELECT e.hash, e.job_id, CASE WHEN v.hash IS NULL OR v.job_id <> e.job_id THEN e.status WHEN v.status = 'failed' AND e.status IN ('ingested', 'indexed') THEN e.status WHEN v.status IN ('failed', 'interrupted') AND previous IS NOT NULL THEN previous ELSE v.status END AS status,
    CASE WHEN v.hash IS NOT NULL AND v.job_id = e.job_id AND v.status = 'indexed' THEN NULL ELSE previous END AS previous FROM e LEFT JOIN v USING (hash)""")
def registry_after_event(spark, sf):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    entries = table(spark, sf, "customer").select(c.alias("hash"), (c % 5).alias("job_id"), pick(c, "queued", "ingested", "ingesting").alias("status"), F.when(c % 4 == 0, "indexed").alias("previous"))
    events = table(spark, sf, "supplier").where("s_suppkey % 10 <> 3").select(s.alias("hash"), (s % 5).alias("job_id"), pick(s, "failed", "interrupted", "indexed").alias("status"))
    return jobs.after_event(entries, events)


@query("""WITH l AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'remove' ELSE 'record' END AS op, event_type AS kind FROM events)
    SELECT job_id, arg_max(kind, seq) AS kind, min(seq) AS first FROM l GROUP BY job_id HAVING arg_max(op, seq) = 'record'""")
def ledger_entries(spark, sf):
    op = F.when(F.col("event_type") == "purchase", "remove").otherwise("record")
    return jobs.ledger(table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_type").alias("kind")))


@query(f"WITH {_JOBS} SELECT id, CASE WHEN id::BIGINT % 3 = 0 AND status = 'queued' THEN 'cancelled' WHEN id::BIGINT % 3 = 0 AND status = 'running' THEN 'cancelling' ELSE status END AS status FROM j")
def cancelled_jobs(spark, sf):
    j = _jobs(spark, sf)
    return jobs.cancelled(j, j.where(F.col("id").cast("long") % 3 == 0).select("id")).select("id", "status")


@query("""WITH f AS (SELECT p_partkey AS k, 'Doc ' || (p_partkey % 50) || '.PDF' AS filename FROM part WHERE p_partkey % 9 <> 0), n AS (SELECT k, 'Doc-' || regexp_extract(filename, '[0-9]+') AS stem, row_number() OVER (PARTITION BY lower(filename) ORDER BY k) AS i FROM f)
    SELECT k AS source_hash, stem || CASE WHEN i = 1 THEN '' ELSE '-' || i END || '.PDF' AS staged_name FROM n""")
def staged_names(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("source_hash"), F.concat(F.lit("a/Doc "), k % 50, F.lit(".PDF")).alias("filename"), (k % 9 != 0).alias("exists"))
    return jobs.staged_names(p).select("source_hash", "staged_name")


_TRUST_SQL = """t AS (SELECT c_custkey::VARCHAR AS source_hash, CASE c_custkey % 4 WHEN 0 THEN ' approved ' WHEN 1 THEN 'odd' WHEN 2 THEN 'stale' END AS review_status, CASE c_custkey % 3 WHEN 0 THEN 'textbook' WHEN 1 THEN 'web' ELSE 'blog' END AS source_type,
    CASE c_custkey % 5 WHEN 0 THEN 'Official' WHEN 1 THEN 'unofficial' WHEN 2 THEN 'nobody' END AS source_group, CASE c_custkey % 2 WHEN 0 THEN '1999' ELSE 'long ago' END AS publication_year FROM customer)"""


def _trust_rows(spark, sf):
    c = F.col("c_custkey")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), (c % len(names) + 1).cast("int"))
    return table(spark, sf, "customer").select(
        c.cast("string").alias("source_hash"), pick(" approved ", "odd", "stale", None).alias("review_status"), pick("textbook", "web", "blog").alias("source_type"),
        pick("Official", "unofficial", "nobody", None, None).alias("source_group"), pick("1999", "long ago").alias("publication_year"),
    )


@query(f"""WITH {_TRUST_SQL} SELECT source_hash, CASE WHEN trim(review_status) IN ('approved', 'stale') THEN trim(review_status) ELSE 'unreviewed' END AS review_status, CASE WHEN source_type = 'blog' THEN 'unknown' ELSE source_type END AS source_type,
    CASE WHEN lower(source_group) IN ('official', 'unofficial') THEN lower(source_group) ELSE 'ungrouped' END AS source_group, CASE lower(source_group) WHEN 'official' THEN 1.0 WHEN 'unofficial' THEN 0.8 ELSE 0.1 END::DOUBLE AS reliability_weight,
    coalesce(try_cast(publication_year AS INT), 0) AS publication_year FROM t""")
def trust_normal(spark, sf):
    rows = _trust_rows(spark, sf).withColumns({c: F.lit(None).cast("string") for c in ("expires_at", "reviewed_by", "notes")})
    return jobs.trust_entry(rows).select("source_hash", "review_status", "source_type", "source_group", "reliability_weight", F.coalesce("publication_year", F.lit(0)).alias("publication_year"))


@query(f"""WITH {_TRUST_SQL} SELECT source_hash, review_status IN (' approved ', 'stale') AND source_group IN ('Official', 'unofficial') AS ok FROM (SELECT source_hash, coalesce(review_status, '') AS review_status, coalesce(source_group, '') AS source_group FROM t)""")
def trust_bulk(spark, sf):
    """Which of many updates of trust entries are taken."""
    rows = _trust_rows(spark, sf).withColumn("publication_year", F.expr("try_cast(publication_year AS INT)"))
    return jobs.trust_updates(rows.limit(0), rows, list(retrieval.SOURCE_WEIGHTS))[1].select("source_hash", "ok")


@query("""SELECT 'documents' AS name, count(*) AS n FROM documents WHERE source NOT IN ('src2', 'src4') UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents WHERE source NOT IN ('src2', 'src4')""")
def forced_cleanup(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("source_hash"))
    uploads = d.distinct().withColumn("forced", F.col("source_hash").isin("src2", "src4"))
    left = jobs.forced_cleanup({"documents": d, "sources": d.distinct()}, uploads)
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in left.items()]
    return counts[0].unionByName(counts[1])


@query("""SELECT event_type AS phase, count(*) FILTER (event_id % 5 <> 0) AS files_processed, count(*) FILTER (event_id % 5 = 0) AS files_failed, round(max(epoch(ts)) - min(epoch(ts)), 3) AS elapsed_s,
    array_to_string((list_sort(list(DISTINCT 'f' || user_id || ': bad') FILTER (event_id % 5 = 0)))[1:20], '|') AS errors FROM events GROUP BY ALL""")
def run_summary(spark, sf):
    e = table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    log = e.select(F.col("event_type").alias("phase"), F.concat(F.lit("f"), "user_id").alias("file"), F.when(F.col("event_id") % 5 == 0, "failed").otherwise("done").alias("status"), F.lit("bad").alias("error"), at.alias("started"), at.alias("ended"))
    return jobs.run_summary(log).withColumn("errors", F.array_join("errors", "|"))


@query("""SELECT c_custkey AS job_id, 0 AS rank FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0 UNION ALL SELECT s_suppkey, 1 FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 <> 0
    UNION ALL SELECT s_suppkey, 1 FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 <> 0 AND s_suppkey NOT IN (SELECT c_custkey FROM customer)""")
def recovered_jobs(spark, sf):
    registry = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("job_id"))
    ledger = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("job_id"))
    known = registry.unionByName(ledger).where("job_id % 2 = 0")
    return lifecycle.recovered(registry, ledger, known)


@query("SELECT DISTINCT source AS source_hash FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 0)")
def unseen_sources(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("source_hash"), "doc_id")
    return jobs.unseen(d, d.where("doc_id % 50 = 0"))


@query("SELECT event_id AS done, '__RAG_PROGRESS__ {\"phase\":\"' || event_type || '\",\"done\":' || event_id || ',\"unit\":\"rows\",\"user_id\":' || user_id || '}' AS value FROM events")
def progress_lines(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("phase"), F.col("event_id").alias("done"), F.lit(None).cast("long").alias("total"), F.lit("rows").alias("unit"), "user_id")
    lines = jobs.progress_line(e, ["user_id", "done"])
    return lines.select(F.get_json_object(F.substring("value", len(incremental.PROGRESS_MARK) + 1, 1000), "$.done").cast("long").alias("done"), "value")


@query("SELECT count(*) = 0 AS resumable, (SELECT count(*) FROM documents) AS inputs FROM documents WHERE doc_id % 4 = 0 AND doc_id % 2 <> 0")
def resume_check(spark, sf):
    """Whether all that a checkpoint lists is among the inputs."""
    names = table(spark, sf, "documents").select(F.col("doc_id").alias("name"))
    done = names.where("name % 4 = 0")
    return names.agg(F.count(F.lit(1)).alias("inputs")).select(jobs.resumable(names.where("name % 2 = 0"), done).alias("resumable"), "inputs")


@query(r"""SELECT doc_id, length(regexp_replace(t, '^[\s\x0B]+|[\s\x0B]+$', '', 'g'))::BIGINT AS markdown_char_count, len(regexp_extract_all(t, '(?m)^##[\s\x0B]+Page[\s\x0B]+[0-9]+'))::BIGINT AS page_markers, ((length(t) - length(replace(t, '[Vision Analysis]', ''))) // 17)::BIGINT AS enrichment_markers, (length(t) - length(replace(t, '|', '')))::BIGINT AS table_markers,
    len(regexp_extract_all(t, '\$[^$\n]{1,160}\$'))::BIGINT AS equation_markers FROM (SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '$', ''), chr(92), ''), chr(10), chr(10) || '## Page 3 '), ' the ', ' | $x$ '), ' und ', ' [Vision Analysis] ') AS t FROM documents)""")
def markdown_marks(spark, sf):
    """Marks of whole documents, with frequent words and the ends of lines turned into marks."""
    text = F.coalesce("text", F.lit(""))
    for a, b in (("$", ""), ("\\", ""), ("\n", "\n## Page 3 "), (" the ", " | $x$ "), (" und ", " [Vision Analysis] ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    counts = documents.markdown_counts(text)
    return table(spark, sf, "documents").select("doc_id", *[counts[c].alias(c) for c in ("markdown_char_count", "page_markers", "enrichment_markers", "table_markers", "equation_markers")])


@query("""WITH p AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'data/a.pdf' WHEN 1 THEN '/srv/data/b.PDF' WHEN 2 THEN '/srv/data/../x.pdf' ELSE 'notes.txt' END AS path FROM customer)
    SELECT id, CASE id % 4 WHEN 2 THEN 'outside' WHEN 3 THEN 'not a PDF' END AS problem FROM p""")
def pdf_paths(spark, sf):
    c = F.col("c_custkey")
    path = F.element_at(F.array(*map(F.lit, ("data/a.pdf", "/srv/data/b.PDF", "/srv/data/../x.pdf", "notes.txt"))), (c % 4 + 1).cast("int"))
    return lifecycle.safe_pdfs(table(spark, sf, "customer").select(c.alias("id"), path.alias("path")), "/srv/data").select("id", "problem")


@query("""SELECT c_custkey AS id, '/srv/assets/s/' || c_custkey || '.png' AS path FROM customer WHERE c_custkey % 4 IN (0, 3)""")
def asset_paths(spark, sf):
    c = F.col("c_custkey")
    name = F.when(c % 4 == 1, F.concat(F.lit("a/b"), c)).otherwise(F.concat(F.lit("img_"), c))
    path = F.when(c % 4 == 2, F.concat(F.lit("../"), c)).otherwise(F.concat(F.lit("s/"), c, F.lit(".png")))
    rows = table(spark, sf, "customer").select(c.alias("id"), name.alias("asset_id"), path.alias("relative_path"))
    return lifecycle.safe_assets(rows, "/srv/assets/").select("id", "path")


@query("""WITH a AS (SELECT p_partkey % 40 AS asset_id, p_partkey AS created_at, p_name AS description FROM part) SELECT asset_id, min(created_at) AS created_at, arg_min(description, created_at) AS description FROM a GROUP BY ALL""")
def asset_entries(spark, sf):
    """Assets by content: of several entries of one id the first stays."""
    p = table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("asset_id"), F.col("p_partkey").alias("created_at"), F.col("p_name").alias("description"))
    return lifecycle.add_assets(p.where("created_at % 2 = 0"), p.where("created_at % 2 <> 0"))


@query("SELECT DISTINCT doc_id // 2 AS path FROM documents WHERE doc_id % 6 < 3 AND doc_id // 2 NOT IN (SELECT doc_id // 2 FROM documents WHERE doc_id % 6 >= 3)")
def paths_to_delete(spark, sf):
    """Paths that only deleted documents use."""
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 2).alias("path"), (F.col("doc_id") % 6).alias("source_hash"))
    return lifecycle.shared_paths(d, d.where("source_hash < 3"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS upload_id, l_linenumber - 1 AS i FROM lineitem), g AS (SELECT upload_id, count(*) AS received FROM p GROUP BY ALL), w AS (SELECT upload_id, unnest(range(0, 7)) AS i FROM g), m AS (SELECT upload_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS missing FROM w ANTI JOIN p USING (upload_id, i) GROUP BY ALL)
    SELECT upload_id, received::INT AS received, coalesce(missing, '') AS missing FROM g LEFT JOIN m USING (upload_id)""")
def missing_parts(spark, sf):
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("upload_id"), (F.col("l_linenumber") - 1).alias("index"), F.lit(7).alias("total"))
    out = lifecycle.missing_parts(parts, F.col("total"))
    return out.select("upload_id", "received", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents QUALIFY k <= 3")
def newest_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    out = rec.newest(d, ["source"], [F.desc("doc_id")], 3)
    return out.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id"))).cast("long").alias("k"))


@query(f"WITH {RECORDS_SQL} SELECT id, doc_id, length(content)::BIGINT AS char_count, CASE WHEN source_hash = 'src5' THEN 'official' ELSE 'ungrouped' END AS source_group FROM records WHERE source_hash IN ('src5', 'src6')")
def records_of_sources(spark, sf):
    """Shown rows of two sources with their trust group."""
    trust = spark.createDataFrame([("src5", " Official"), ("src6", "odd")], "source_hash string, source_group string")
    rows = corpus.records(spark, sf).where(rec.of_source(["src5", "src6"]))
    return rec.public_rows(retrieval.trusted_groups(rows, trust)).select("id", "doc_id", "char_count", "source_group")


@query("SELECT doc_id, md5(doc_id::VARCHAR || '|' || lang || '|' || n_chars) AS mark FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL")
def change_marks(spark, sf):
    d = table(spark, sf, "documents").where("lang IS NOT NULL AND n_chars IS NOT NULL")
    return d.select("doc_id", tx.change_mark(F.col("doc_id"), F.col("lang"), F.col("n_chars")).alias("mark"))


# --- signed requests

_SECRET = b"a key of this query alone"
_PADS = [bytes(b ^ pad for b in _SECRET.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]
_HMAC = f"unhex(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode({{0}})))))"
_URL = "rtrim(translate(base64({0}), '+/', '-_'), '=')"
_UPLOADS = f"""u AS (SELECT conv_id, list_sort(list(sha256(coalesce(text, '')))) AS ups, list_sort(coalesce(list(sha256(coalesce(text, ''))) FILTER (role = 'user'), [])) AS dups FROM conversations GROUP BY conv_id),
    p AS (SELECT *, '{{"duplicate_hashes":[' || array_to_string(list_transform(dups, lambda x: '"' || x || '"'), ',') || '],"expires_at":' || (1700000900 + conv_id) || ',"upload_hashes":[' || array_to_string(list_transform(ups, lambda x: '"' || x || '"'), ',') || ']}}' AS body FROM u)"""


def _uploads(spark, sf):
    c = table(spark, sf, "conversations")
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    return c.groupBy("conv_id").agg(F.collect_list(own).alias("ups"), F.collect_list(F.when(F.col("role") == "user", own)).alias("dups"))


@query(f"WITH {_UPLOADS} SELECT conv_id, {_URL.format('encode(body)')} || '.' || {_URL.format(_HMAC.format('body'))} AS token FROM p")
def signed_tokens(spark, sf):
    """Tokens for uploads of the texts of all conversations."""
    return _uploads(spark, sf).select("conv_id", tokens.signed(F.col("ups"), F.col("dups"), 1_700_000_000 + F.col("conv_id"), _SECRET).alias("token"))


@query(f"WITH {_UPLOADS} SELECT conv_id, conv_id % 4 NOT IN (1, 2) AND (conv_id % 4 <> 3 OR len(ups) = len(list_distinct(ups))) AND 1700000900 + conv_id >= 1700000950 AS valid FROM p")
def token_verdicts(spark, sf):
    """Which tokens hold at some second: some have another key, a changed letter, or come for uploads without repeats."""
    k = F.col("conv_id") % 4
    own = tokens.signed(F.col("ups"), F.col("dups"), 1_700_000_000 + F.col("conv_id"), _SECRET)
    other = tokens.signed(F.col("ups"), F.col("dups"), 1_700_000_000 + F.col("conv_id"), b"another key")
    given = F.when(k == 1, other).when(k == 2, F.concat(F.lit("A"), own)).otherwise(own)
    ups = F.when(k == 3, F.array_distinct("ups")).otherwise(F.col("ups"))
    return _uploads(spark, sf).select("conv_id", tokens.valid(given, ups, F.col("dups"), F.lit(1_700_000_950), _SECRET).alias("valid"))
