"""From files to texts: which files, what to do with each page, how parsed items become Markdown.

Parsers, OCR and vision models are functions that the caller gives; this module holds what happens
around them: probing, routing, isolation of errors, assembly.

Defined cases: a page that fails is empty and does not fail its document; null texts are empty;
documents without pages are routed to OCR; ties go by page and place; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.plans import sections
from lodestone.sources import files

SAMPLED_PAGES = 5
WINDOW_PAGES = 16
#: Labels of parsed items (fixed values).
PICTURE, CODE, FORMULA = ("picture", "figure", "chart"), ("code",), ("formula", "equation")
#: Modes of parsing (fixed values).
PARSERS = ("manual", "docling", "hybrid")


# --- files


def found_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """PDF files below a folder, or the one file, in the order of their paths; an error if the path does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return listed.where(F.lower("path").endswith(".pdf")).orderBy("path")


def output_names(listed: DataFrame, root: str) -> DataFrame:
    """Adds output_name: the stem, with six bytes of the BLAKE2s digest of the path below the root where
    stems clash, in any case of letters, and the file lies in a folder below the root."""

    @F.pandas_udf("string")
    def digest(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: hashlib.blake2s(p.encode(), digest_size=6).hexdigest())

    inside = F.regexp_replace(F.when(F.col("path").startswith(root), F.substring("path", F.lit(len(root) + 1), F.length("path"))).otherwise(F.col("path")), r"^[/\\\\]+", "")
    stem = F.regexp_replace(tx.file_name(F.col("path")), r"\.[^.]*$", "")
    named = listed.withColumns({"__stem": stem, "__inside": F.replace(inside, F.lit("\\"), F.lit("/"))})
    clash = named.groupBy(F.lower("__stem").alias("__low")).agg((F.count(F.lit(1)) > 1).alias("__clash"))
    joined = named.join(clash, F.lower("__stem") == F.col("__low"))
    apart = F.col("__clash") & F.contains("__inside", F.lit("/"))
    name = F.when(apart, F.concat("__stem", F.lit("__"), digest(F.lower("__inside")))).otherwise(F.col("__stem"))
    return joined.withColumn("output_name", F.concat(name, F.lit(".md"))).drop("__stem", "__inside", "__low", "__clash")


def by_kind(paths: DataFrame) -> DataFrame:
    """Adds ``reader``: pdf, text, or null for files that are not read."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\\\]+)$", 1))
    return paths.withColumn("reader", F.when(suffix == "pdf", "pdf").when(suffix.isin("md", "markdown", "txt"), "text"))


def to_do(inputs: DataFrame, source_map: DataFrame) -> DataFrame:
    """Adds ``skipped`` to files (output_name, size, mtime_ns, source_hash, exists).

    A file is skipped if its output exists and its entry of the source map states the same size and
    time, or, where the entry states none, the same hash.
    """
    known = source_map.select("output_name", F.col("source_size").alias("__size"), F.col("source_mtime_ns").alias("__time"), F.col("source_hash").alias("__hash"))
    joined = inputs.join(known, "output_name", "left")
    stated = F.col("__size").isNotNull() & F.col("__time").isNotNull()
    hashed = F.coalesce("__hash", F.lit("")) != ""
    same = F.when(stated, (F.col("__size") == F.col("size")) & (F.col("__time") == F.col("mtime_ns"))).otherwise(hashed & (F.col("__hash") == F.col("source_hash")))
    return joined.withColumn("skipped", F.coalesce(F.col("exists") & same, F.lit(False))).drop("__size", "__time", "__hash")


def new_uploads(uploads: DataFrame, known: DataFrame, most_bytes: int) -> DataFrame:
    """Adds ``verdict`` to uploads (name, source_hash, size): too_large, duplicate (of a known source or
    an earlier upload by name), or accepted."""
    first = uploads.groupBy("source_hash").agg(F.min("name").alias("__first"))
    joined = uploads.join(first, "source_hash", "left").join(known.select("source_hash", F.lit(True).alias("__known")).distinct(), "source_hash", "left")
    twice = F.col("__known").isNotNull() | (F.col("name") != F.col("__first"))
    return joined.withColumn("verdict", F.when(F.col("size") > most_bytes, "too_large").when(twice, "duplicate").otherwise("accepted")).drop("__first", "__known")


def assembled(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Uploads in parts (upload_id, index, data) put together: (upload_id, complete, size, sha256); a part sent twice counts once."""
    once = parts.groupBy("upload_id", "index").agg(F.max("data").alias("data"))
    each = once.groupBy("upload_id").agg(F.sort_array(F.collect_list(F.struct("index", "data"))).alias("p"), F.count(F.lit(1)).alias("n"), F.max("index").alias("last"))
    whole = F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["data"]))
    joined = totals.join(each, "upload_id", "left")
    complete = F.coalesce((F.col("n") == F.col("total")) & (F.col("last") == F.col("total") - 1), F.lit(False))
    body = F.when(complete, whole)
    return joined.select("upload_id", complete.alias("complete"), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("sha256"))


# --- pages


def page_texts(documents: DataFrame, read: Callable[[bytes], Iterator[Callable[[], str]]]) -> DataFrame:
    """Rows (path, page_no, text, error) of documents (path, content).

    ``read`` opens a document and gives a function for each page. A page whose function fails is an
    empty row with the error's text; so is a document that does not open, as page 0.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                rows = []
                try:
                    for number, page in enumerate(read(content), 1):
                        try:
                            rows.append((path, number, page() or "", None))
                        except Exception as e:  # whatever a parser raises on one page
                            rows.append((path, number, "", f"{type(e).__name__}: {e}"))
                except Exception as e:
                    rows.append((path, 0, "", f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"])

    raw = documents.select("path", "content").mapInPandas(run, "path string, page_no int, text string, error string")
    return raw.withColumn("text", sections.single_blank_lines(F.col("text")))


def sampled_pages(pages: DataFrame, most: int = SAMPLED_PAGES) -> DataFrame:
    """Pages (doc_id, page_no, ...) for a quick look: all of a short document, else ``most`` evenly spread ones with the first and the last."""
    counted = pages.groupBy("doc_id").agg(F.max("page_no").alias("__n"))
    step = (F.col("__n") - 1) / F.lit(float(max(1, most - 1)))
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * step).cast("int") + 1)
    joined = pages.join(counted, "doc_id")
    return joined.where((F.col("__n") <= most) | F.array_contains(spread, F.col("page_no").cast("int"))).drop("__n")


def usable_documents(pages: DataFrame, least: int = 20, alnum: float = 0.35) -> DataFrame:
    """Rows (doc_id, usable): whether the texts of a document's pages together can be used."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n")
    return pages.groupBy("doc_id").agg(tx.is_usable_text(text, least, alnum).alias("usable"))


def routes(documents: DataFrame, pages: DataFrame, ocr: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Adds ``route`` to documents (doc_id): text, ocr or images.

    By mode: manual takes the text, docling the OCR. Hybrid takes the text if a sample of pages and
    then all of them are usable; else the OCR where ``ocr(doc_id, content)`` gives anything, else images of pages.
    """
    if mode not in PARSERS:
        raise ValueError(f"unknown parser {mode}, known are {PARSERS}")
    if mode != "hybrid":
        return documents.withColumn("route", F.lit("text" if mode == "manual" else "ocr"))
    sample = usable_documents(sampled_pages(pages)).withColumnRenamed("usable", "__sample")
    whole = usable_documents(pages).withColumnRenamed("usable", "__whole")
    read = ocr.where(tx.stripped(F.coalesce("content", F.lit(""))) != "").select("doc_id", F.lit(True).alias("__read")).distinct()
    joined = documents.join(sample, "doc_id", "left").join(whole, "doc_id", "left").join(read, "doc_id", "left")
    text = F.coalesce(F.col("__sample") & F.col("__whole"), F.lit(False))
    return joined.withColumn("route", F.when(text, "text").when(F.col("__read"), "ocr").otherwise("images")).drop("__sample", "__whole", "__read")


def described_pages(images: DataFrame, window: int = WINDOW_PAGES) -> DataFrame:
    """Scanned documents as Markdown from descriptions (doc_id, page_no, image_no, description): (doc_id, content, windows).

    Descriptions that say nothing are left out, and so are pages without any. ``windows``: how many
    windows of pages with images a model reads one after the other.
    """
    numbered = images.groupBy("doc_id").agg(F.ceil(F.count_distinct("page_no") / window).cast("long").alias("windows"))
    good = images.where(tx.usable_description(F.col("description")))
    line = F.concat(F.lit("> [Page Image Analysis]: "), F.trim("description"))
    page = good.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("image_no", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n\n"))
    parts = page.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", text.alias("text")))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("content")).join(numbered, "doc_id")


# --- parsed items


def item_kind(label: Column) -> Column:
    """picture, code, formula or other, from an item's label."""
    has = lambda words: F.coalesce(F.lower(label), F.lit("")).rlike("|".join(words))
    return F.when(has(PICTURE), "picture").when(has(CODE), "code").when(has(FORMULA), "formula").otherwise("other")


def item_markdown(label: Column, content: Column, language: Column) -> Column:
    """An item as Markdown: pictures by their description, code in fences, formulas between dollars, all else as it is."""
    kind, bare = item_kind(label), tx.stripped(F.coalesce(content, F.lit("")))
    tongue = F.regexp_replace(F.lower(F.trim(F.coalesce(language, F.lit("")))), "[^a-z0-9_+.#-]", "")
    fenced = F.when(bare.startswith("```"), bare).otherwise(F.concat(F.lit("```"), F.when(tongue == "unknown", "").otherwise(tongue), F.lit("\n"), bare, F.lit("\n```")))
    marked = bare.startswith("$") | bare.startswith("\\(") | bare.startswith("\\[")
    formula = F.when(marked, bare).when(F.contains(bare, F.lit("\n")), F.concat(F.lit("$$\n"), bare, F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), bare, F.lit("$")))
    picture = F.concat(F.lit("\n> [Vision Analysis]: "), F.coalesce(content, F.lit("")), F.lit("\n"))
    return F.when(kind == "picture", picture).when(bare == "", "").when(kind == "code", fenced).when(kind == "formula", formula).otherwise(F.coalesce(content, F.lit("")))


def rendered(items: DataFrame) -> DataFrame:
    """Documents as Markdown from their items (doc_id, item_no, label, content, language)."""
    shown = items.withColumn("__text", item_markdown(F.col("label"), F.col("content"), F.col("language"))).where("__text <> ''")
    parts = F.sort_array(F.collect_list(F.struct("item_no", "__text")))
    return shown.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["__text"]), "\n\n").alias("content"))


def page_assets(items: DataFrame) -> DataFrame:
    """Pictures, code, formulas and tables of each page, in order: (doc_id, page_no, assets). Items without a page are on page 1."""
    asset = (item_kind(F.col("label")) != "other") | F.contains(F.lower("label"), F.lit("table"))
    shown = items.where(asset).withColumn("__text", item_markdown(F.col("label"), F.col("content"), F.col("language"))).where("__text <> ''")
    parts = F.sort_array(F.collect_list(F.struct("item_no", "__text")))
    return shown.groupBy("doc_id", F.coalesce("page_no", F.lit(1)).alias("page_no")).agg(F.transform(parts, lambda x: x["__text"]).alias("assets"))


def with_assets(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """Documents as Markdown: each page's text and then its assets, blank lines between; pages with neither are left out."""
    texts = pages.select("doc_id", F.col("page_no").cast("long").alias("page_no"), "text")
    joined = texts.join(assets.select("doc_id", F.col("page_no").cast("long").alias("page_no"), "assets"), ["doc_id", "page_no"], "full")
    own = F.when(F.coalesce("text", F.lit("")) != "", F.array("text")).otherwise(F.array().cast("array<string>"))
    parts = joined.withColumn("__parts", F.concat(own, F.coalesce("assets", F.array().cast("array<string>")))).where(F.size("__parts") > 0)
    page = F.sort_array(F.collect_list(F.struct("page_no", F.array_join("__parts", "\n\n").alias("text"))))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(page, lambda x: x["text"]), "\n\n").alias("content"))


def hinted_pages(pages: DataFrame, hints: str = "kinds") -> DataFrame:
    """Pages that have assets to extract, with ``enriched``: whether code or formulas need the careful parser."""
    careful = F.arrays_overlap(F.col(hints), F.array(F.lit("code"), F.lit("formula")))
    return pages.where(F.size(hints) > 0).withColumn("enriched", careful)


def item_blocks(items: DataFrame) -> DataFrame:
    """Items (doc_id, item_no from 1, label, class_name, page_no, content) as blocks in reading order.

    Items without content are left out unless they are figures or charts.
    """
    kind = tx.modality(F.col("label"), F.col("class_name"))
    text = F.coalesce("content", F.lit(""))
    made = items.withColumns({"modality": kind, "content": text, "page_num": F.coalesce("page_no", F.lit(1)).cast("int")})
    kept = made.where((F.col("content") != "") | F.col("modality").isin("figure", "chart"))
    name = tx.prefixed_id("block", F.col("doc_id"), F.col("page_num"), F.col("item_no"), F.col("modality"), F.substring("content", 1, 100))
    return kept.select("doc_id", "page_num", F.col("item_no").cast("int").alias("reading_order"), name.alias("block_id"), "modality", "content", F.when(F.col("modality") == "equation", F.col("content")).otherwise("").alias("latex"))


def document_states(documents: DataFrame, blocks: DataFrame, failed: DataFrame) -> DataFrame:
    """Adds ``status``: failed where ``failed(doc_id)`` says so, ready with blocks, else empty."""
    counted = blocks.select("doc_id").distinct().withColumn("__some", F.lit(True))
    wrong = failed.select("doc_id").distinct().withColumn("__failed", F.lit(True))
    joined = documents.join(counted, "doc_id", "left").join(wrong, "doc_id", "left")
    return joined.withColumn("status", F.when(F.col("__failed"), "failed").when(F.col("__some"), "ready").otherwise("empty")).drop("__some", "__failed")


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of the text files of a folder (md, markdown, txt)."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.{md,markdown,txt}").select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return files.text_blocks(texts.withColumn("doc_id", tx.prefixed_id("doc", F.col("path"))))
