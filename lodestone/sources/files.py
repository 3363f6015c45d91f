"""Scans: Markdown and text files, binary files, page sidecars, result pages of a web search.

Defined cases: an empty folder gives no rows; empty files are empty texts; a sidecar that is null,
damaged or of another version gives no pages; a result page without links gives no rows; an archive
over a limit is an error.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

SIDECAR_VERSION = 1


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files of a folder: (doc_id, title, file_path, content), in the order of their names."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.input_file_name().alias("file_path"), F.col("value").alias("content"))
    stem = F.regexp_replace(F.url_decode(F.element_at(F.split("file_path", "/"), -1)), r"\.md$", "")
    return files.select(tx.stable_id("doc", stem).alias("doc_id"), stem.alias("title"), "file_path", "content").orderBy("file_path")


def binaries(spark: SparkSession, path: str, glob: str = "*.{pdf,PDF}") -> DataFrame:
    """Binary files below a folder with the SHA-256 of their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("source_hash"), "content")


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row: number and total size of the files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("length").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def text_blocks(docs: DataFrame) -> DataFrame:
    """Paragraphs of text files as blocks: (doc_id, page_num, reading_order, block_id, modality, content)."""
    parts = F.filter(F.transform(F.split("content", r"\n\s*\n"), tx.normalized), lambda x: x != "")
    rows = docs.select("doc_id", F.posexplode(parts).alias("reading_order", "content"))
    kind = F.when(F.col("content").startswith("#"), "section_header").otherwise("text")
    return rows.select("doc_id", F.lit(1).alias("page_num"), "reading_order", tx.prefixed_id("block", F.col("doc_id"), F.col("reading_order")).alias("block_id"), kind.alias("modality"), "content")


def to_sidecar(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, text) as one JSON sidecar for each document."""
    body = F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"])
    packed = pages.groupBy("doc_id").agg(body.alias("pages"))
    return packed.select("doc_id", F.to_json(F.struct(F.lit(SIDECAR_VERSION).alias("version"), F.size("pages").alias("page_count"), "pages")).alias("sidecar"))


def from_sidecar(sidecars: DataFrame) -> DataFrame:
    """Pages of sidecars of the known version; others give no rows."""
    read = sidecars.select("doc_id", F.from_json("sidecar", "version int, page_count int, pages array<string>").alias("s")).where(F.col("s.version") == SIDECAR_VERSION)
    return read.select("doc_id", F.posexplode("s.pages").alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page_no"), "text")


def zip_members(archives: DataFrame, max_entries: int = 500, max_bytes: int = 1 << 30, suffix: str = ".pdf") -> DataFrame:
    """Members of ZIP files (path, content): (path, name, bytes), without folders, hidden and unsafe names;
    a name that occurs again, in any archive, gets a number.

    An archive over a limit is an error, not a shorter result.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    wanted = [e for e in z.infolist() if not e.is_dir() and e.filename.lower().endswith(suffix) and not any(p in ("..", "__MACOSX") or p.startswith(".") for p in e.filename.split("/"))]
                    if len(wanted) > max_entries or sum(e.file_size for e in wanted) > max_bytes:
                        raise ValueError(f"{path}: too many or too large members")
                    for i, e in enumerate(wanted):
                        yield pd.DataFrame({"path": [path], "place": [i], "name": [e.filename.rsplit("/", 1)[-1]], "bytes": [z.read(e)]})

    read = archives.select("path", "content").mapInPandas(run, "path string, place int, name string, bytes binary")
    number = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("path", "place"))
    stem, tail = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    unique = F.when(F.col("__n") == 1, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("__n"), tail))
    return read.withColumn("__n", number).select("path", unique.alias("name"), "bytes")


class _Results(HTMLParser):
    """Links and snippets of a search result page."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.into: int | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        kinds = (a.get("class") or "").split()
        if tag == "a" and ("result-link" in kinds or "result__a" in kinds):
            self.rows.append(["", a.get("href") or "", ""])
            self.into = 0
        elif self.rows and ("result-snippet" in kinds or "result__snippet" in kinds):
            self.into = 2

    def handle_endtag(self, tag):
        if tag in ("a", "td", "div"):
            self.into = None

    def handle_data(self, data):
        if self.into is not None:
            self.rows[-1][self.into] += data


def search_results(pages: DataFrame, most: int) -> DataFrame:
    """Rows (page_id, place, title, url, snippet) of result pages (page_id, html), a url once, ``most`` a page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for page, html in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True):
                parser = _Results()
                parser.feed(html or "")
                out += [(page, i, " ".join(t.split()), u, " ".join(s.split())) for i, (t, u, s) in enumerate(parser.rows)]
            yield pd.DataFrame(out, columns=["page_id", "place", "title", "url", "snippet"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "html").mapInPandas(run, f"page_id {kind}, place int, title string, url string, snippet string")
    clean = rows.withColumn("url", tx.unwrapped_url(F.col("url"))).where("url <> ''")
    first = clean.groupBy("page_id", "url").agg(F.min_by(F.struct("place", "title", "snippet"), "place").alias("r"))
    numbered = first.select("page_id", "r.title", "url", "r.snippet", F.row_number().over(Window.partitionBy("page_id").orderBy("r.place")).alias("place"))
    return numbered.where(F.col("place") <= most)
