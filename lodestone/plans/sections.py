"""Sectioning: documents to outlines, outlines to summary and chunk records.

An outline is a table of sections (doc_id, ord, level, title, node_id, page_start, page_end,
next_title), pages are a table (doc_id, page_no, text). Outlines come from Markdown headings, from
a document's own bookmarks, or from its table of contents; everything after that (tree, page
ranges, texts, chunks, records) is the same plan for all of them.

Defined cases: null texts are empty; a document without any heading is one root section; a
document without text still has its summary record; repeated documents give repeated records;
documents of any number of headings take time in proportion to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

#: What a heading, a paragraph break, an entry of a table of contents look like (fixed values).
HASH_HEADING = re.compile(r"(?m)^(#{1,6})\s+([^\n#][^\n]{2,160})\s*$")
NUMBERED_HEADING = re.compile(r"(?m)^((\d+(?:\.\d+)*|[A-Z](?:\.\d+)*)\s+[^\n]{3,120})$")
PARAGRAPH = r"\n\s*\n"
DOT_LEADER = r"^\s*((?:[A-Z]+|[A-Z]?\d+(?:\.\d+)*|[A-Z](?:\.\d+)*))\s+(.+?)\s+(?:[.…]\s*){2,}(\d{1,4})\s*$"
PLAIN_ENTRY = r"^\s*([A-Z]|\d+(?:\.\d+)*)\s+([A-Za-z][^\n.]{2,}?)\s+(\d{1,4})\s*$"
#: Lines that are page numbers, and lines that begin the numbered text (fixed values).
PAGE_NUMBER_LINE = r"^(?:\[begin lecture [^\]]+\]\s*)?\(?\d+\)?$"
NUMBERED_LINE = r"^\d+(?:\.\d+)*\s+[A-Za-z][^\n.]{2,}$"
#: Marks of text that a vision model has added (fixed values).
ENRICHED = ("[Vision Analysis]", "[Page Image Analysis]")
TOC_PAGES = 8
TOGETHER = 1 << 22
LISTED_TITLES = 80

NODE = "doc_id, ord, level, title, node_id, page_start, page_end, next_title"


# --- texts as lines


def _lines(text: Column) -> Column:
    return F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")


def without_front_matter(text: Column) -> Column:
    """The text from its second numbered line on; the whole text if it has no two."""
    lines = _lines(text)
    begins = lambda x: F.trim(x).rlike(NUMBERED_LINE) & ~F.lower(F.trim(x)).rlike(PAGE_NUMBER_LINE)
    places = F.filter(F.transform(lines, lambda x, i: F.when(begins(x), i)), lambda i: i.isNotNull())
    tail = F.slice(lines, F.try_element_at(places, F.lit(2)) + 1, F.size(lines))
    whole = F.array_join(lines, "\n")
    return tx.stripped(F.when(F.size(places) >= 2, F.array_join(tail, "\n")).otherwise(whole))


def single_blank_lines(text: Column) -> Column:
    """Lines without trailing space, runs of blank lines as one, no blank line at either end."""
    return tx.stripped(F.regexp_replace(F.array_join(F.transform(_lines(text), tx.right_stripped), "\n"), r"\n{3,}", "\n\n"))


def heading_span(text: Column, title: Column, next_title: Column | None = None, strict: bool = False) -> Column:
    """Lines from the first that is like ``title`` up to the one that is like ``next_title``.

    A line is like a title if either holds the other once case, leading numbers and signs are gone.
    So a blank line is like every title that has a letter, unless the search is ``strict``.
    """
    def place(plain: Column, wanted: Column) -> Column:
        inside = lambda x: F.contains(wanted, x) & (F.lit(not strict) | (x != ""))
        return F.array_position(F.transform(plain, lambda x: (wanted != "") & (F.contains(x, wanted) | inside(x))), F.lit(True)).cast("int")

    def from_place(s: Column) -> Column:
        cut = lambda begin: F.when(begin > 0, F.struct(F.slice(s["lines"], begin, F.size(s["lines"])).alias("lines"), F.slice(s["plain"], begin, F.size(s["plain"])).alias("plain"))).otherwise(F.struct(s["lines"].alias("lines"), s["plain"].alias("plain")))
        return tx.bound(place(s["plain"], s["title"]), cut)

    def to_place(s: Column, until: Column) -> Column:
        stop = place(F.slice(s["plain"], 2, F.greatest(F.size(s["plain"]) - 1, F.lit(0))), until)
        return tx.bound(stop, lambda n: F.when(n > 0, F.slice(s["lines"], 1, n)).otherwise(s["lines"]))

    whole = tx.bound(F.split(text, "\n"), lambda x: F.struct(x.alias("lines"), F.transform(x, tx.normalized_heading).alias("plain"), tx.normalized_heading(title).alias("title")))
    kept = tx.bound(whole, from_place)
    if next_title is None:
        kept = kept["lines"]
    else:
        kept = tx.bound(F.struct(kept.alias("s"), tx.normalized_heading(next_title).alias("z")), lambda x: F.when(next_title != "", to_place(x["s"], x["z"])).otherwise(x["s"]["lines"]))
    return tx.stripped(F.array_join(kept, "\n"))


def is_enriched(text: Column) -> Column:
    """Whether a vision model has added to a text."""
    return F.coalesce(F.contains(text, F.lit(ENRICHED[0])) | F.contains(text, F.lit(ENRICHED[1])), F.lit(False))


# --- outlines


def _title(raw: str) -> str:
    flat = " ".join(raw.replace("ﬁ", "fi").replace("ﬂ", "fl").split())
    return re.sub(r"\s+\d{1,4}$", "", flat).strip()


def heading_rows(text: str) -> list[tuple[int, int, str]]:
    """(offset, level, title) of the headings of a Markdown text, in order."""
    found = {m.start(): (m[2].count("."), m[1]) for m in NUMBERED_HEADING.finditer(text)}
    found |= {m.start(): (len(m[1]) - 1, m[2]) for m in HASH_HEADING.finditer(text)}
    rows = [(at, level, _title(raw)) for at, (level, raw) in sorted(found.items())]
    noise = ("contents", "table of contents")
    return [r for r in rows if not re.fullmatch(r"\d{1,4}", r[2]) and r[2].lower() not in noise]


def headings(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """Rows (doc_id, ord, offset, level, title, body): each heading with its text up to the next.

    A heading may reach over line ends, so offsets are needed, which no built-in gives.
    """
    kind = "array<struct<ord:int,offset:int,level:int,title:string,body:string>>"

    @F.pandas_udf(kind)
    def read(texts: pd.Series) -> pd.Series:
        def one(text: str) -> list[dict]:
            rows = heading_rows(text)
            ends = [*(r[0] for r in rows), len(text)][1:]
            return [{"ord": i, "offset": at, "level": level, "title": title, "body": text[at:end].strip()} for i, ((at, level, title), end) in enumerate(zip(rows, ends, strict=False))]

        return texts.map(one)

    return docs.select("doc_id", F.inline(read(without_front_matter(F.col(text_col)))))


def markdown_outline(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outline, pages) of Markdown documents (doc_id, doc_title, content): heading i owns page i + 1."""
    heads = headings(docs)
    page = (F.col("ord") + 1).cast("long")
    titled = heads.join(docs.select("doc_id", "doc_title"), "doc_id")
    node = tx.stable_id("markdown", F.col("doc_title"), F.col("ord"), F.col("title"))
    outline = titled.select("doc_id", "ord", "level", "title", node.alias("node_id"), page.alias("page_start"), page.alias("page_end"), F.lit("").alias("next_title"))
    pages = heads.select("doc_id", page.alias("page_no"), F.col("body").alias("text"))
    bare = docs.join(heads.select("doc_id").distinct(), "doc_id", "left_anti")
    one = F.lit(1).cast("long")
    root = bare.select("doc_id", F.lit(0).alias("ord"), F.lit(0).alias("level"), F.col("doc_title").alias("title"), tx.stable_id("markdown", F.col("doc_title")).alias("node_id"), one.alias("page_start"), one.alias("page_end"), F.lit("").alias("next_title"))
    whole = bare.select("doc_id", one.alias("page_no"), tx.normalize_page(without_front_matter(F.col("content"))).alias("text"))
    return outline.unionByName(root), pages.unionByName(whole)


def toc_entries(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, ord, number, title, page) of the lines of tables of contents in texts (doc_id, text)."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", tx.stripped(F.col("line")))
    dotted = F.col("line").rlike(DOT_LEADER)
    part = lambda k: F.when(dotted, F.regexp_extract("line", DOT_LEADER, k)).otherwise(F.regexp_extract("line", PLAIN_ENTRY, k))
    found = lines.where(dotted | F.col("line").rlike(PLAIN_ENTRY)).where(~F.lower("line").isin("contents", "table of contents"))
    rows = found.select("doc_id", "line_no", part(1).alias("number"), tx.clean_title(part(2)).alias("title"), part(3).cast("long").alias("page"))
    rows = rows.where((F.col("title") != "") & ~F.col("title").rlike("^[0-9]+$"))
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).alias("ord"), "number", "title", "page")


def toc_outline(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Outline by the tables of contents on the first pages; ``titles(doc_id, doc_title)``."""
    first = pages.where(F.col("page_no") <= TOC_PAGES)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n")
    entries = toc_entries(first.groupBy("doc_id").agg(text.alias("text"))).join(titles.select("doc_id", "doc_title"), "doc_id")
    node = tx.stable_id("toc", F.col("doc_title"), F.col("ord"), F.col("number"), F.col("title"))
    level = F.length("number") - F.length(F.replace("number", F.lit(".")))
    return entries.select("doc_id", "ord", level.alias("level"), F.trim(F.concat_ws(" ", "number", "title")).alias("title"), node.alias("node_id"), F.col("page").alias("page_start"))


def bookmark_outline(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """Outline by bookmarks (doc_id, ord, level, title, page), ord from 0 in reading order; pages are held to the document's."""
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("n"))
    named = marks.withColumn("title", tx.clean_title(F.col("title"))).where("title <> ''").join(last, "doc_id", "left")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    page = F.greatest(F.lit(1), F.least(F.coalesce("page", F.lit(1)), F.coalesce("n", F.lit(1)))).cast("long")
    numbered = named.withColumn("ord", order)
    return numbered.select("doc_id", (F.col("ord") - 1).alias("ord"), "level", "title", tx.stable_id("section", F.col("ord"), F.col("title")).alias("node_id"), page.alias("page_start"))


def section_tree(outline: DataFrame) -> DataFrame:
    """Adds parent_ord (the section that a section lies in, -1 for none), next_ord (the next section
    of the same or a smaller level, null at the end), section_path and has_children.

    A document's outline is one array, read once with a stack of open sections, so the work is in
    proportion to its length (and the depth, for the paths).
    """
    titled = "title" in outline.columns
    kind = "array<struct<ord:int,parent_ord:int,next_ord:int,section_path:string,has_children:boolean>>"

    @F.pandas_udf(kind)
    def read(orders: pd.Series, levels: pd.Series, titles: pd.Series) -> pd.Series:
        def one(order, level, title) -> list[dict]:
            out: list[dict] = []
            open_: list[int] = []
            for i, (o, depth) in enumerate(zip(order, level, strict=True)):
                while open_ and level[open_[-1]] >= depth:
                    out[open_.pop()]["next_ord"] = int(o)
                up = out[open_[-1]] if open_ else None
                if up:
                    up["has_children"] = True
                path = f"{up['section_path']} > {title[i]}" if up else title[i]
                out.append({"ord": int(o), "parent_ord": up["ord"] if up else -1, "next_ord": None, "section_path": path, "has_children": False})
                open_.append(i)
            return out

        return pd.Series([one(*x) for x in zip(orders, levels, titles, strict=True)])

    row = F.struct("ord", "level", (F.coalesce("title", F.lit("")) if titled else F.lit("")).alias("title"))
    each = outline.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("h"))
    read_rows = each.select("doc_id", F.inline(read(F.col("h.ord"), F.col("h.level"), F.col("h.title"))))
    tree = outline.join(read_rows, ["doc_id", "ord"])
    return tree if titled else tree.drop("section_path")


def with_page_ends(tree: DataFrame, page_count: Column) -> DataFrame:
    """Adds page_end and next_title: a section ends on the page before the next one of the same or a
    smaller level begins, at least on its own first page, and the last ones on the last page."""
    following = tree.select("doc_id", F.col("ord").alias("next_ord"), F.col("page_start").alias("__page"), F.col("title").alias("__title"))
    end = F.when(F.col("__page").isNull(), page_count).otherwise(F.greatest(F.col("page_start"), F.col("__page") - 1))
    title = F.when(F.col("__page") == F.col("page_start"), F.col("__title")).otherwise("")
    return tree.join(following, ["doc_id", "next_ord"], "left").withColumns({"page_end": end.cast("long"), "next_title": title}).drop("__page", "__title")


def section_texts(sections: DataFrame, pages: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``body``: the texts of a section's pages joined by blank lines, cut to its headings."""
    on = (sections["doc_id"] == pages["doc_id"]) & pages["page_no"].between(sections["page_start"], sections["page_end"])
    met = sections.select("doc_id", "ord", "page_start", "page_end").join(pages, on).select(sections["doc_id"], "ord", "page_no", "text")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n")
    whole = met.groupBy("doc_id", "ord").agg(text.alias("__text"))
    joined = sections.join(whole, ["doc_id", "ord"], "left")
    return joined.withColumn("body", F.coalesce(heading_span(F.col("__text"), F.col("title"), F.col("next_title"), strict), F.lit(""))).drop("__text")


# --- chunks and records


def split_texts(docs: DataFrame, max_chars: int, overlap_chars: int, text_col: str = "text", id_col: str = "doc_id", separator: str = PARAGRAPH) -> DataFrame:
    """Rows (doc_id, chunk_index, content): paragraphs packed greedily up to ``max_chars``.

    A paragraph that is too long stands alone, in slices that overlap. Greedy packing depends on all
    that came before in the text, so a text is one pass over its paragraphs. Chunks leave a task in batches
    of some ``TOGETHER`` characters, so it holds the text of one batch and little beside it.
    """

    step = max(1, max_chars - overlap_chars)
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaks = re.compile(separator)

        def one(text: str) -> list[str]:
            groups: list[list[str]] = []
            room = -1
            for part in filter(None, map(str.strip, breaks.split(text))):
                if len(part) > max_chars:
                    starts = range(0, max(1, len(part) - max_chars + step), step)
                    groups += [[part[a : a + max_chars].strip()] for a in starts]
                    room = -1
                    continue
                if room >= len(part) + 2:
                    groups[-1].append(part)
                    room -= len(part) + 2
                else:
                    groups.append([part])
                    room = max_chars - len(part)
            return [x for x in map("\n\n".join, groups) if x]

        for b in batches:
            row, at, held, size = [], [], [], 0
            for i, text in enumerate(b.column(1)):
                chunks = one(text.as_py())
                row += [i] * len(chunks)
                at += range(len(chunks))
                held += chunks
                size += sum(map(len, chunks))
                if size >= TOGETHER:
                    yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(held, pa.string())], names=["doc_id", "chunk_index", "content"])
                    row, at, held, size = [], [], [], 0
            if row:
                yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(held, pa.string())], names=["doc_id", "chunk_index", "content"])

    return given.mapInArrow(packed, f"doc_id {kind}, chunk_index int, content string")


def records_of(docs: DataFrame, outline: DataFrame, pages: DataFrame, target_tokens: int = 400, overlap_tokens: int = 40, mode: str = "hybrid", strict: bool = False) -> DataFrame:
    """Summary and chunk records of documents (doc_id, doc_title) with their outlines and pages.

    One document summary; a section summary for each section of level 0 or 1 or with children, below
    the summary of the section that it lies in; chunks of sections without children, below the
    nearest summary, numbered through the document in the order of the sections. For ``strict`` see
    ``heading_span``; without it a text may begin at its first blank line.
    """
    max_chars, overlap = max(800, 4 * target_tokens), max(0, 4 * overlap_tokens)
    titles = docs.select("doc_id", "doc_title").distinct()
    tree = outline if "section_path" in outline.columns else section_tree(outline)
    sections = section_texts(tree, pages, strict).join(titles, "doc_id")
    key = tx.stable_id("doc", F.col("doc_title"))
    tag_list = tx.tags(F.col("doc_title"), F.col("section_path"))
    summary_of = lambda node: tx.stable_id(key, "summary", node)
    above = tree.select("doc_id", F.col("ord").alias("parent_ord"), F.col("node_id").alias("__parent"))
    base = sections.join(above, ["doc_id", "parent_ord"], "left").withColumns(
        {
            "key": key, "tags": tag_list, "own_summary": summary_of(F.col("node_id")), "summarised": (F.col("level") <= 1) | F.col("has_children"),
            "above": F.when(F.col("__parent").isNull(), key).otherwise(summary_of(F.col("__parent"))),
            "summary": tx.summary_sentence(F.col("title"), F.col("section_path"), F.col("page_start"), F.col("page_end"), tag_list, mode),
        }
    )
    columns = ["id", "doc_id", "parent_id", "node_type", "chunk_index", "title", "section_path", "content", "summary", "tags", "page_start", "page_end"]
    summaries = base.where("summarised").select(
        F.col("own_summary").alias("id"), F.col("key").alias("doc_id"), F.col("above").alias("parent_id"), F.lit("section_summary").alias("node_type"),
        F.lit(-1).cast("long").alias("chunk_index"), "title", "section_path", F.col("summary").alias("content"), "summary", "tags", "page_start", "page_end",
    )
    leaves = base.where("NOT has_children")
    cut = split_texts(leaves.withColumn("__key", F.struct("doc_id", "ord")), max_chars, overlap, "body", "__key")
    parts = cut.select("doc_id.doc_id", "doc_id.ord", F.col("chunk_index").alias("at"), F.col("content").alias("part")).join(leaves, ["doc_id", "ord"])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "at")) - 1
    head = F.concat(F.lit("Section: "), F.col("section_path"), F.lit("\nPages: "), tx.page_range(F.col("page_start"), F.col("page_end")), F.lit("\n\n"))
    chunks = parts.withColumn("number", number.cast("long")).select(
        tx.stable_id(F.col("key"), "chunk", F.col("node_id"), F.col("at")).alias("id"), F.col("key").alias("doc_id"),
        F.when(F.col("summarised"), F.col("own_summary")).otherwise(F.col("above")).alias("parent_id"), F.lit("chunk").alias("node_type"),
        F.col("number").alias("chunk_index"), "title", "section_path", F.concat(head, "part").alias("content"), "summary", "tags", "page_start", "page_end",
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"])
    counted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__pages"))
    whole = titles.join(outline.groupBy("doc_id").agg(listed.alias("t")), "doc_id", "left").join(counted, "doc_id", "left")
    names = F.coalesce("t", F.array().cast("array<string>"))
    doc_tags = tx.tags(F.col("doc_title"), F.array_join(names, " \n "))
    first, last = F.when(F.col("__pages") > 0, F.lit(1).cast("long")), F.when(F.col("__pages") > 0, F.col("__pages"))
    text = tx.summary_sentence(F.col("doc_title"), F.col("doc_title"), first, last, doc_tags, mode)
    list_ = F.array_join(F.transform(F.slice(names, 1, LISTED_TITLES), lambda x: F.concat(F.lit("- "), x)), "\n")
    documents = whole.select(
        key.alias("id"), key.alias("doc_id"), F.lit("").alias("parent_id"), F.lit("document_summary").alias("node_type"), F.lit(-1).cast("long").alias("chunk_index"),
        F.col("doc_title").alias("title"), F.col("doc_title").alias("section_path"), F.concat(text, F.lit("\n\nSections:\n"), list_).alias("content"),
        text.alias("summary"), doc_tags.alias("tags"), first.alias("page_start"), last.alias("page_end"),
    )
    return documents.select(columns).unionByName(summaries.select(columns)).unionByName(chunks.select(columns))


def records(docs: DataFrame, target_tokens: int = 400, overlap_tokens: int = 40, strict: bool = False) -> DataFrame:
    """Records of Markdown documents (doc_id, title, content)."""
    named = docs.select("doc_id", F.col("title").alias("doc_title"), "content")
    return records_of(named, *markdown_outline(named), target_tokens, overlap_tokens, strict=strict)


def paged_outline(docs: DataFrame, pages: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outline, pages) of documents (doc_id, doc_title, content) with page texts.

    The first of these that gives any section counts: Markdown, if it is enriched or no page has
    text; the bookmarks; the tables of contents; the headings of the joined pages; Markdown.
    """
    own_text = pages.where(tx.stripped(F.col("text")) != "").select("doc_id").distinct()
    enriched = docs.where(is_enriched(F.col("content"))).select("doc_id")
    paged = docs.join(own_text, "doc_id", "left_semi").join(enriched, "doc_id", "left_anti")
    counted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__pages"))

    def ended(outline: DataFrame) -> DataFrame:
        tree = section_tree(outline).join(counted, "doc_id")
        return with_page_ends(tree, F.col("__pages")).drop("__pages", "next_ord", "parent_ord", "section_path", "has_children")

    by_marks = bookmark_outline(marks.join(paged.select("doc_id"), "doc_id", "left_semi"), pages)
    rest = paged.join(by_marks.select("doc_id").distinct(), "doc_id", "left_anti")
    by_toc = toc_outline(pages.join(rest.select("doc_id"), "doc_id", "left_semi"), rest)
    bare = rest.join(by_toc.select("doc_id").distinct(), "doc_id", "left_anti")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n")
    joined = pages.groupBy("doc_id").agg(text.alias("content")).join(bare.select("doc_id", "doc_title"), "doc_id")
    other = docs.join(paged.select("doc_id"), "doc_id", "left_anti").select("doc_id", "doc_title", "content")
    by_text = markdown_outline(joined)[0]  # its sections count their own pages, the document keeps its pages
    by_markdown, own_pages = markdown_outline(other)
    columns = [c.strip() for c in NODE.split(",")]
    outline = ended(by_marks.unionByName(by_toc)).select(columns)
    kept = pages.join(paged.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("page_no").cast("long").alias("page_no"), "text")
    return outline.unionByName(by_text.select(columns)).unionByName(by_markdown.select(columns)), kept.unionByName(own_pages)


def with_source(records: DataFrame, docs: DataFrame, source_map: DataFrame) -> DataFrame:
    """Adds source_hash, source_pdf_name and source_pdf_path to records, by the Markdown name of their document.

    ``docs(doc_title, markdown_name)``, ``source_map(markdown_name, source_hash, source_pdf_name,
    source_pdf_path)``; a document that the map does not know keeps empty ones.
    """
    names = ["source_hash", "source_pdf_name", "source_pdf_path"]
    known = docs.select(tx.stable_id("doc", F.col("doc_title")).alias("doc_id"), "markdown_name").distinct().join(source_map.select("markdown_name", *names), "markdown_name")
    joined = records.drop(*names).join(known.drop("markdown_name"), "doc_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in names})
