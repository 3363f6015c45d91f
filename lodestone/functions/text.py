"""Scalar text functions as column expressions; all run inside generated JVM code.

Defined cases: a null text counts as empty unless a function says otherwise; texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no support for a claim (fixed values).
SUPPORT_STOPWORDS = [
    "about", "above", "after", "also", "because", "before", "being", "between", "could", "every", "from", "have", "into", "more", "only", "same", "should",
    "source", "sources", "than", "that", "their", "there", "these", "this", "through", "using", "when", "where", "which", "with", "would",
]
#: Words that are no tags (fixed values).
TAG_STOPWORDS = ["and", "for", "the", "with", "from", "into", "this", "that", "lecture", "optional", "reading", "section", "summary"]
KEYWORD = "[A-Za-z][A-Za-z0-9_-]{2,}"
LABEL = r"\[[SW][0-9]+\]"
OVERHEAD_TOKENS = 64
TRUNCATION_NOTICE = "\n\n[Context truncated to fit prompt budget.]"
LEAST_BLOCK_TOKENS = 96


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stable_id(*parts: Column | str) -> Column:
    """First 24 hex digits of the SHA-1 of the parts joined by NUL."""
    return F.substring(F.sha1(F.concat_ws("\0", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])), 1, 24)


def prefixed_id(prefix: str, *parts: Column) -> Column:
    """Prefix, underscore and 20 hex digits of the SHA-1 of the parts joined by the unit separator; null parts are empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(joined), 1, 20))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def normalized(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+", " "))


def stripped(text: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(text, r"^[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+$", "")


def right_stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+$", "")


def duplicate_group(text: Column) -> Column:
    """Name of the group of texts that differ in case and punctuation only."""
    plain = F.regexp_replace(F.lower(normalized(text)), r"[^\p{L}\p{N}_]+", " ")
    return F.concat(F.lit("dup_"), F.substring(F.sha1(plain), 1, 16))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4.0)).cast("long")


def context_estimate(text: Column) -> Column:
    return token_estimate(text) + OVERHEAD_TOKENS


def word_count(text: Column) -> Column:
    """Number of white-space separated words, 1 at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))).cast("long")


def fitted(text: Column, budget: Column) -> Column:
    """Text cut to a token budget with a notice; empty if the budget is below the least block."""
    room = F.greatest(F.lit(0), 4 * (budget - OVERHEAD_TOKENS) - len(TRUNCATION_NOTICE)).cast("int")
    cut = right_stripped(F.substring(text, F.lit(1), room))
    short = F.when(cut == "", F.lit("")).otherwise(F.concat(cut, F.lit(TRUNCATION_NOTICE)))
    return F.when(context_estimate(text) <= budget, text).when(budget < LEAST_BLOCK_TOKENS, F.lit("")).otherwise(short)


def snippet(text: Column, limit: int = 360) -> Column:
    flat = normalized(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(right_stripped(F.substring(flat, 1, limit - 1)), F.lit("...")))


def keywords(text: Column) -> Column:
    """Distinct lower-case words that can support a claim."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), LABEL, " ")
    words = F.transform(F.regexp_extract_all(clean, F.lit(f"({KEYWORD})"), F.lit(1)), F.lower)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, SUPPORT_STOPWORDS)))


def terms(text: Column) -> Column:
    """Lower-case index terms in order, with repeats."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9_]{2,})"), F.lit(1)), F.lower)


def tags(*parts: Column, most: int = 12) -> Column:
    """The first distinct words of the parts that are no stop words."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" \n ", *parts)), F.lit("([a-z][a-z0-9-]{2,})"), F.lit(1))
    return F.slice(F.array_except(F.array_distinct(words), F.array(*map(F.lit, TAG_STOPWORDS))), 1, most)


def citation_labels(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({LABEL})"), F.lit(1))


def claim_fragments(text: Column) -> Column:
    """Sentences and lines that are not blank."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def page_label(start: Column, end: Column) -> Column:
    several = (start > 0) & (end > 0) & (start != end)
    return F.when(several, F.concat(F.lit("pages "), start, F.lit("-"), end)).when(start > 0, F.concat(F.lit("page "), start)).otherwise("")


def page_range(start: Column, end: Column) -> Column:
    one, other = start.cast("string"), end.cast("string")
    return (
        F.when(start.isNull() & end.isNull(), "unknown")
        .when(end.isNull() | (start == end), one)
        .when(start.isNull(), other)
        .otherwise(F.concat(one, F.lit("-"), other))
    )


def clean_title(title: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.replace(F.replace(title, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), r"\s+", " "))
    return F.trim(F.regexp_replace(flat, r"\s+[0-9]{1,4}$", ""))


def normalized_heading(title: Column) -> Column:
    bare = F.regexp_replace(clean_title(title), r"^[0-9]+(\.[0-9]+)*\s+", "")
    return F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "")


def is_noise_line(line: Column) -> Column:
    bare = F.trim(line)
    return bare.rlike("^[0-9]{1,4}$") | F.lower(bare).isin("contents", "table of contents")


def normalize_page(text: Column) -> Column:
    """Lines without trailing space, noise lines, or a first or last line that occurs over twice."""
    raw = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")
    lines = F.filter(F.transform(raw, right_stripped), lambda x: ~is_noise_line(x))
    bare = bound(lines, lambda x: F.struct(x.alias("lines"), F.transform(x, lambda y: F.trim(y)).alias("bare")))

    def counted(s: Column) -> Column:
        count = lambda v: F.size(F.filter(s["bare"], lambda x: x == v))
        first, last = F.try_element_at(s["bare"], F.lit(1)), F.try_element_at(s["bare"], F.lit(-1))
        first_goes = F.coalesce(count(first) > 2, F.lit(False))  # and then counts no more for the last line
        ends = bound(first_goes, lambda f: F.struct(f.alias("first"), F.coalesce(count(last) - F.when(f & (first == last), 1).otherwise(0) > 2, F.lit(False)).alias("last")))
        return F.struct(s["lines"].alias("lines"), F.size(s["lines"]).alias("n"), ends.alias("goes"))

    def kept(s: Column) -> Column:
        stays = lambda x, i: (F.trim(x) != "") & ~((i == 0) & s["goes"]["first"]) & ~((i == s["n"] - 1) & s["goes"]["last"])
        return F.array_join(F.when(s["n"] < 4, s["lines"]).otherwise(F.filter(s["lines"], stays)), "\n")

    return stripped(bound(bound(bare, counted), kept))


def is_usable_text(text: Column, least: int = 20, alnum: float = 0.35) -> Column:
    visible = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    n = F.length(visible)
    broken = n - F.length(F.replace(visible, F.lit("�"), F.lit("")))
    good = F.length(F.regexp_replace(visible, r"[^\p{L}\p{N}]", ""))
    return (n >= least) & (broken <= 0.01 * n) & (good >= alnum * n)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def suggests_table(text: Column) -> Column:
    lines = _lines(text)
    spaced = lambda x: (F.regexp_count(x, F.lit(r"\S+\s{2,}\S+")) >= 2) | ((F.regexp_count(x, F.lit(r"[0-9]+(\.[0-9]+)?")) >= 3) & x.rlike(r"\s{2,}"))
    return F.exists(lines, lambda x: x.contains("|") | x.contains("\t")) | (F.size(F.filter(lines, spaced)) >= 3)


def suggests_equation(text: Column) -> Column:
    marks = lambda x: (F.regexp_count(x, F.lit(r"[=+\-*/^_∑∫√≤≥≈≠]")) >= 2) & x.rlike("[A-Za-z0-9]")
    return F.exists(_lines(text), lambda x: (F.length(x) >= 6) & (marks(x) | x.rlike(r"\b[A-Za-z]\s*=\s*[^=]+")))


def page_class(chars: Column, images: Column) -> Column:
    """What a page is, from its number of characters and of images."""
    scanned = (chars < 30) & (images > 0)
    return F.when(scanned, "scanned").when((chars >= 30) & (images > 0), "mixed").when(chars >= 30, "digital").otherwise("unknown")


def safe_component(value: Column, fallback: str) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "[^A-Za-z0-9_.-]+", "-"), "^[.-]+|[.-]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def human_bytes(size: Column) -> Column:
    """A size in its unit with one place; a tie goes to the even digit, as in Python and C."""
    expr = F.format_string("%d B", size.cast("long"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        expr = F.when(size >= 1024**power, F.format_string("%.1f " + unit, F.bround(size / float(1024**power), 1))).otherwise(expr)
    return expr


def unwrapped_url(url: Column) -> Column:
    """The target of a search page's link: scheme added, redirect parameter unwrapped."""
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    target = F.regexp_extract(full, "[?&]uddg=([^&#]*)", 1)
    return F.when(target != "", F.url_decode(target)).otherwise(full)


def asset_marker(asset_id: Column) -> Column:
    return F.concat(F.lit("[[image:"), asset_id, F.lit("]]"))


def summary_sentence(title: Column, path: Column, start: Column, end: Column, tag_list: Column, mode: str = "hybrid") -> Column:
    listed = F.when(F.size(tag_list) > 0, F.array_join(F.slice(tag_list, 1, 8), ", ")).otherwise("general content")
    origin = "deterministic fallback" if mode == "llm" else "outline/heading-derived"
    return F.concat(title, F.lit(f". {origin} summary for "), path, F.lit(". Pages "), page_range(start, end), F.lit(". Tags: "), listed, F.lit("."))


def file_name(path: Column) -> Column:
    """The last part of a path, with either kind of slash."""
    return F.element_at(F.split(path, r"[/\\\\]"), -1)


def source_name(name: Column, source_path: Column, file_path: Column) -> Column:
    """Name of a record's source: its own, else that of its path, else of its file, else 'source'."""
    filled = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(filled(name), file_name(filled(source_path)), file_name(filled(file_path)), F.lit("source"))


def percent_encoded(value: Column) -> Column:
    """A path part with every byte but letters, digits and _.-~ as %XX."""
    form = F.url_encode(value)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def pdf_url(source_hash: Column, mode: str, page: Column | None = None) -> Column:
    """Where a source's PDF is shown or downloaded; empty without a source. A view opens at its page."""
    base = F.concat(F.lit("/api/pdfs/"), percent_encoded(source_hash), F.lit(f"/{mode}"))
    url = base if page is None or mode != "view" else F.when(F.coalesce(page, F.lit(0)) > 0, F.concat(base, F.lit("#page="), page.cast("string"))).otherwise(base)
    return F.when(F.coalesce(source_hash, F.lit("")) == "", F.lit("")).otherwise(url)


def whole_number(value: Column, default: int, least: int = 1, most: int | None = None) -> Column:
    """A number read from text and held to bounds; the default where it is none."""
    read = F.greatest(F.lit(least).cast("long"), value.try_cast("long"))
    held = read if most is None else F.least(read, F.lit(most).cast("long"))
    return F.when(value.try_cast("long").isNull(), F.lit(default).cast("long")).otherwise(held)


def share(value: Column, default: float, least: float = 0.0, most: float = 1.0) -> Column:
    """A fraction read from text and held to bounds; the default, held likewise, where it is none."""
    read = F.coalesce(value.try_cast("double"), F.lit(float(default)))
    return F.least(F.lit(most), F.greatest(F.lit(least), read))


def change_mark(*parts: Column) -> Column:
    """A mark that changes when one of the parts does: MD5 of the parts joined by bars."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def modality(label: Column, kind: Column) -> Column:
    """What a parsed item is, from its label and the name of its class."""
    value = F.lower(F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(kind, F.lit(""))))
    has = lambda *words: value.rlike("|".join(words))
    return (
        F.when(has("table"), "table").when(has("formula", "equation"), "equation").when(has("chart"), "chart")
        .when(has("picture", "figure", "image"), "figure").when(has("section", "heading", "title"), "section_header").otherwise("text")
    )


def usable_description(text: Column) -> Column:
    """Whether a vision model has said something about an image."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return (bare != "") & ~bare.isin(*FAILED_DESCRIPTIONS)


#: What failed descriptions of images read (fixed values).
FAILED_DESCRIPTIONS = ["[Image description failed]", "[Image description empty]", "[Vision analysis disabled]"]
