"""Views of the test tables in the engine's own terms, and the same views as SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.sources import staging
from lodestone.sources.term_index import TermIndex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_index(spark: SparkSession, sf_dir: str, terms: Callable[[Column], Column], documents: DataFrame) -> TermIndex:
    """The stored index of the documents' texts, made at the first question of a session and again once the table's files change.

    ``documents(id, source_hash, text)`` of the table ``documents``.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    mark = hashlib.sha1("\n".join([terms.__name__, *sorted(seen)]).encode()).hexdigest()
    index = TermIndex(spark, f"{staging.folder(spark)}/terms-{mark}", terms)
    if not index.exists():
        index.build(documents)
    return index


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each line of a document that is not blank."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    doc = tx.stable_id("doc", F.col("doc_id"))
    return lines.select(
        tx.stable_id(doc, "chunk", F.col("pos")).alias("id"), doc.alias("doc_id"), doc.alias("parent_id"), F.lit("chunk").alias("node_type"),
        F.concat(F.lit("doc"), "doc_id", F.lit(".md")).alias("file_path"), F.col("pos").cast("long").alias("chunk_index"), F.col("line").alias("content"),
        F.concat(F.lit("Document "), "doc_id").alias("title"), F.concat_ws(" > ", "lang", "source").alias("section_path"),
        (F.floor(F.col("pos") / 3) + 1).cast("long").alias("page_start"), (F.floor(F.col("pos") / 3) + 1 + F.col("pos") % 2).cast("long").alias("page_end"),
        F.lit("").alias("summary"), F.array("lang", "source").alias("tags"), F.col("source").alias("source_hash"),
        F.concat("source", F.lit(".pdf")).alias("source_pdf_name"), F.concat(F.lit("data/"), "source", F.lit(".pdf")).alias("source_pdf_path"), F.col("doc_id").alias("number"),
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary record for each document."""
    docs = table(spark, sf_dir, "documents")
    doc = tx.stable_id("doc", F.col("doc_id"))
    return docs.select(
        doc.alias("id"), doc.alias("doc_id"), F.lit("").alias("parent_id"), F.lit("document_summary").alias("node_type"),
        F.concat(F.lit("doc"), "doc_id", F.lit(".md")).alias("file_path"), F.lit(-1).cast("long").alias("chunk_index"), F.concat(F.lit("Summary of document "), "doc_id").alias("content"),
        F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("lang").alias("section_path"), F.lit(1).cast("long").alias("page_start"), F.lit(1).cast("long").alias("page_end"),
        F.lit("").alias("summary"), F.array("lang", "source").alias("tags"), F.col("source").alias("source_hash"),
        F.concat("source", F.lit(".pdf")).alias("source_pdf_name"), F.concat(F.lit("data/"), "source", F.lit(".pdf")).alias("source_pdf_path"), F.col("doc_id").alias("number"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).unionByName(summaries(spark, sf_dir))


_DOC = "substr(sha1('doc' || chr(0) || doc_id::VARCHAR), 1, 24)"
RECORDS_SQL = f"""
    lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
    chunks AS (SELECT substr(sha1({_DOC} || chr(0) || 'chunk' || chr(0) || pos::VARCHAR), 1, 24) AS id, {_DOC} AS doc_id, {_DOC} AS parent_id, 'chunk' AS node_type,
        'doc' || doc_id || '.md' AS file_path, pos::BIGINT AS chunk_index, line AS content, 'Document ' || doc_id AS title, lang || ' > ' || source AS section_path,
        (pos // 3 + 1)::BIGINT AS page_start, (pos // 3 + 1 + pos % 2)::BIGINT AS page_end, '' AS summary, [lang, source] AS tags, source AS source_hash,
        source || '.pdf' AS source_pdf_name, 'data/' || source || '.pdf' AS source_pdf_path, doc_id AS number FROM lines WHERE trim(line) <> ''),
    summaries AS (SELECT {_DOC} AS id, {_DOC} AS doc_id, '' AS parent_id, 'document_summary' AS node_type, 'doc' || doc_id || '.md' AS file_path, (-1)::BIGINT AS chunk_index,
        'Summary of document ' || doc_id AS content, 'Document ' || doc_id AS title, lang AS section_path, 1::BIGINT AS page_start, 1::BIGINT AS page_end, '' AS summary, [lang, source] AS tags,
        source AS source_hash, source || '.pdf' AS source_pdf_name, 'data/' || source || '.pdf' AS source_pdf_path, doc_id AS number FROM documents),
    records AS (SELECT * FROM chunks UNION ALL SELECT * FROM summaries)
"""


def keywords_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in tx.SUPPORT_STOPWORDS)
    words = rf"list_transform(regexp_extract_all(regexp_replace(coalesce({text}, ''), '\[[SW][0-9]+\]', ' ', 'g'), '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda x: lower(x))"
    return f"list_distinct(list_filter({words}, lambda x: NOT list_contains([{stop}], x)))"
