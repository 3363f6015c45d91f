"""Registered queries from files and pages to sections, blocks and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.corpus import table
from lodestone.functions import hints
from lodestone.functions import text as tx
from lodestone.operators import blocks, intake
from lodestone.plans import sections
from lodestone.plans.registry import query

_STRIP = r"regexp_replace({0}, '^[\s\x0B\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+|[\s\x0B\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '', 'g')"
_RSTRIP = r"regexp_replace({0}, '[\s\x0B\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '')"
_TITLE = r"trim(regexp_replace(trim(regexp_replace(replace(replace({0}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[\s\x0B]+', ' ', 'g')), '[\s\x0B]+[0-9]{{1,4}}$', ''))"
_PLAIN = r"regexp_replace(lower(regexp_replace(" + _TITLE + r", '^[0-9]+(\.[0-9]+)*[\s\x0B]+', '')), '[^a-z0-9]+', '', 'g')"


# --- files


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'text' WHEN 2 THEN 'text' END AS reader FROM pages""")
def file_kinds(spark, sf):
    p = F.col("page_id")
    suffix = F.element_at(F.array(*map(F.lit, (".PDF", ".md", ".x.TXT", ""))), (p % 4 + 1).cast("int"))
    return intake.by_kind(table(spark, sf, "pages").select("page_id", F.concat(F.lit("in/f"), p, suffix).alias("path"))).select("page_id", "reader")


@query()
def output_names(spark, sf):
    """Markdown names of files with clashing stems (BLAKE2s is unknown to SQL; tested against hashlib)."""
    p = F.col("page_id")
    path = F.concat(F.lit("/in/"), F.when(p % 3 == 0, F.concat(F.lit("d"), p, F.lit("/"))).otherwise(""), F.lit("Report"), p % 20, F.lit(".pdf"))
    return intake.output_names(table(spark, sf, "pages").select("page_id", path.alias("path")), "/in").select("page_id", "output_name")


@query("""SELECT o_orderkey AS id, o_orderkey % 5 <> 0 AND CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 <> 0 ELSE o_orderkey % 7 = 0 END AND o_orderkey % 11 <> 0 AS skipped FROM orders""")
def files_to_do(spark, sf):
    """Files that need no new reading: by size and time, or by hash where the entry states neither."""
    k = F.col("o_orderkey")
    inputs = table(spark, sf, "orders").select(k.alias("id"), k.alias("output_name"), k.alias("size"), (k % 3).alias("mtime_ns"), F.concat(F.lit("h"), k % 7).alias("source_hash"), (k % 5 != 0).alias("exists"))
    even = F.col("output_name") % 2 == 0
    entries = inputs.where("id % 11 <> 0").select("output_name", F.when(even, F.col("size")).alias("source_size"), F.when(even, F.greatest("mtime_ns", F.lit(1))).alias("source_mtime_ns"), F.lit("h0").alias("source_hash"))
    return intake.to_do(inputs, entries).select("id", "skipped")


@query("""WITH u AS (SELECT p_partkey AS name, p_partkey % 300 AS source_hash, p_size * 100 AS size FROM part), f AS (SELECT source_hash, min(name) AS first FROM u GROUP BY ALL)
    SELECT name, CASE WHEN size > 4000 THEN 'too_large' WHEN s_suppkey IS NOT NULL OR name <> first THEN 'duplicate' ELSE 'accepted' END AS verdict FROM u JOIN f USING (source_hash) LEFT JOIN supplier ON s_suppkey = source_hash""")
def upload_verdicts(spark, sf):
    k = F.col("p_partkey")
    u = table(spark, sf, "part").select(k.alias("name"), (k % 300).alias("source_hash"), (F.col("p_size") * 100).alias("size"))
    return intake.new_uploads(u, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_hash")), 4000).select("name", "verdict")


@query("""WITH p AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), t AS (SELECT conv_id, max(turn) + 1 AS total, count(*) AS n, min(turn) AS low, string_agg(text, '' ORDER BY turn) AS body FROM p GROUP BY ALL)
    SELECT conv_id AS upload_id, n = total AS complete, CASE WHEN n = total THEN octet_length(encode(body))::BIGINT END AS size, CASE WHEN n = total THEN sha256(body) END AS sha256 FROM t""")
def assembled_uploads(spark, sf):
    c = table(spark, sf, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("upload_id"), F.col("turn").alias("index"), F.col("text").cast("binary").alias("data"))
    totals = c.groupBy("upload_id").agg((F.max("index") + 1).alias("total"))
    return intake.assembled(c, totals)


# --- pages


@query("""WITH n AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY ALL), c AS (SELECT conv_id, turn + 1 AS page_no, last + 1 AS n FROM conversations JOIN n USING (conv_id))
    SELECT conv_id AS doc_id, page_no FROM c WHERE n <= 3 OR page_no IN (1, round_even((n - 1) / 2.0, 0)::BIGINT + 1, n)""")
def sampled_pages(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"))
    return intake.sampled_pages(c, 3)


@query(r"""WITH p AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY ALL), v AS (SELECT conv_id, regexp_replace(CASE WHEN conv_id % 4 = 0 THEN '...' ELSE t END, '[ \t\n\x0B\f\r]', '', 'g') AS s FROM p),
    u AS (SELECT conv_id, length(s) >= 20 AND length(regexp_replace(s, '[^\p{L}\p{N}]', '', 'g')) >= 0.35 * length(s) AS good FROM v)
    SELECT conv_id AS doc_id, CASE WHEN good THEN 'text' WHEN conv_id % 8 = 0 THEN 'ocr' ELSE 'images' END AS route FROM u""")
def parser_routes(spark, sf):
    """How each document is parsed: by its text, by OCR, or by images of its pages."""
    own = F.when(F.col("conv_id") % 4 == 0, F.when(F.col("turn") == 0, "...").otherwise("")).otherwise(F.coalesce("text", F.lit("")))
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), own.alias("text"))
    docs = pages.select("doc_id").distinct()
    ocr = docs.select("doc_id", F.when(F.col("doc_id") % 8 == 0, "read").otherwise(" ").alias("content"))
    return intake.routes(docs, pages, ocr)


@query(r"""WITH d AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '[Image description failed]' WHEN 1 THEN ' seen ' || turn || ' ' ELSE 'also ' || turn END AS text FROM conversations),
    p AS (SELECT conv_id, turn // 2 AS page, string_agg('> [Page Image Analysis]: ' || trim(text), chr(10) || chr(10) ORDER BY turn) AS body FROM d WHERE turn % 3 <> 0 GROUP BY ALL),
    w AS (SELECT conv_id, ceil(count(DISTINCT turn // 2) / 2.0)::BIGINT AS windows FROM d GROUP BY ALL)
    SELECT conv_id AS doc_id, string_agg('## Page ' || page || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY page) AS content, any_value(windows) AS windows FROM p JOIN w USING (conv_id) GROUP BY conv_id""")
def described_pages(spark, sf):
    t = F.col("turn")
    text = F.when(t % 3 == 0, "[Image description failed]").when(t % 3 == 1, F.concat(F.lit(" seen "), t, F.lit(" "))).otherwise(F.concat(F.lit("also "), t))
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(t / 2).alias("page_no"), t.alias("image_no"), text.alias("description"))
    return intake.described_pages(rows, 2)


@query(r"SELECT conv_id, turn, trim(t) <> '' AND trim(t) NOT IN ('[Image description failed]', '[Image description empty]', '[Vision analysis disabled]') AS usable FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN ' [Vision analysis disabled] ' WHEN 2 THEN '[Image description failed]' || substr(coalesce(text, ''), 1, (conv_id % 2)::BIGINT) ELSE coalesce(text, '') END AS t FROM conversations)")
def usable_descriptions(spark, sf):
    """Texts of conversations as descriptions of images, some of which failed, and some of these with a letter more."""
    t, text = F.col("turn") % 4, F.coalesce("text", F.lit(""))
    failed = F.concat(F.lit("[Image description failed]"), F.substring(text, F.lit(1), (F.col("conv_id") % 2).cast("int")))
    given = F.when(t == 3, " [Vision analysis disabled] ").when(t == 2, failed).otherwise(text)
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.usable_description(given).alias("usable"))


# --- parsed items

_ITEMS = """i AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'code' WHEN 2 THEN 'formula' WHEN 3 THEN 'picture' ELSE 'section_header' END AS label, regexp_replace(coalesce(text, ''), '[^A-Za-z ]+', '', 'g') AS raw, CASE turn % 2 WHEN 0 THEN ' Py!thon ' ELSE 'unknown' END AS lang FROM conversations),
    r AS (SELECT *, trim(raw) AS bare FROM i), m AS (SELECT conv_id, turn, label, raw, CASE label WHEN 'picture' THEN chr(10) || '> [Vision Analysis]: ' || raw || chr(10)
    WHEN 'code' THEN CASE WHEN bare = '' THEN '' ELSE '```' || CASE WHEN turn % 2 = 0 THEN 'python' ELSE '' END || chr(10) || bare || chr(10) || '```' END WHEN 'formula' THEN CASE WHEN bare = '' THEN '' ELSE '$' || bare || '$' END ELSE CASE WHEN bare = '' THEN '' ELSE raw END END AS t FROM r)"""


def _items(spark, sf):
    t = F.col("turn")
    label = F.element_at(F.array(*map(F.lit, ("text", "code", "formula", "picture", "section_header"))), (t % 5 + 1).cast("int"))
    raw = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]+", "")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (t + 1).alias("item_no"), label.alias("label"), raw.alias("content"), F.when(t % 2 == 0, " Py!thon ").otherwise("unknown").alias("language"), F.when(t % 4 != 3, F.floor(t / 4) + 1).cast("long").alias("page_no"))


@query(f"WITH {_ITEMS} SELECT conv_id AS doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn)) AS content FROM m WHERE t <> '' GROUP BY ALL")
def rendered_items(spark, sf):
    return intake.rendered(_items(spark, sf)).select("doc_id", F.md5("content").alias("content"))


@query(f"""WITH {_ITEMS}, a AS (SELECT conv_id, CASE WHEN turn % 4 <> 3 THEN turn // 4 + 1 ELSE 1 END AS page, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS t FROM m WHERE t <> '' AND label IN ('code', 'formula', 'picture') GROUP BY ALL),
    p AS (SELECT conv_id, turn + 1 AS page, text AS t FROM conversations WHERE turn < 2), j AS (SELECT conv_id, page, concat_ws(chr(10) || chr(10), nullif(p.t, ''), a.t) AS t FROM p FULL JOIN a USING (conv_id, page))
    SELECT conv_id AS doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY page)) AS content FROM j WHERE t <> '' GROUP BY ALL""")
def pages_with_assets(spark, sf):
    """Page texts with the pictures, code and formulas of their pages."""
    pages = table(spark, sf, "conversations").where("turn < 2").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text")
    return intake.with_assets(pages, intake.page_assets(_items(spark, sf))).select("doc_id", F.md5("content").alias("content"))


@query(f"""WITH {_ITEMS}, k AS (SELECT *, CASE label WHEN 'formula' THEN 'equation' WHEN 'picture' THEN 'figure' WHEN 'section_header' THEN 'section_header' ELSE 'text' END AS modality, CASE WHEN turn % 4 <> 3 THEN turn // 4 + 1 ELSE 1 END AS page FROM r)
    SELECT 'block_' || substr(sha1(conv_id || chr(31) || page || chr(31) || (turn + 1) || chr(31) || modality || chr(31) || substr(raw, 1, 100)), 1, 20) AS block_id, modality, page::INT AS page_num, (turn + 1)::INT AS reading_order, CASE WHEN modality = 'equation' THEN raw ELSE '' END AS latex
    FROM k WHERE raw <> '' OR modality = 'figure'""")
def item_blocks(spark, sf):
    items = _items(spark, sf).withColumn("class_name", F.lit("Item"))
    return intake.item_blocks(items).select("block_id", "modality", "page_num", "reading_order", "latex")


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 10 = 0 THEN 'failed' WHEN c_custkey % 3 = 0 THEN 'ready' ELSE 'empty' END AS status FROM customer")
def document_states(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    return intake.document_states(d, d.where("doc_id % 3 = 0"), d.where("doc_id % 10 = 0"))


# --- hints


_FORMULA = r"""list_has_any([contains(TEXT, m) FOR m IN [LATEX]], [true]) OR regexp_matches(TEXT, '(?:^|[^$])\$[^$\n]{2,}\$(?:[^$]|$)') OR regexp_matches(TEXT, '\\\[[\s\S]{2,}?\\\]|\\\([\s\S]{2,}?\\\)')
    OR len(list_filter(list_filter(list_transform(string_split(TEXT, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 6), lambda x: (len(regexp_extract_all(x, '[=+\-*/^_∑∫√≤≥≈≠]')) >= 2 AND regexp_matches(x, '[A-Za-z0-9]')) OR regexp_matches(x, '(?:^|[^\p{L}\p{N}_])[A-Za-z][\s\x0B]*=[\s\x0B]*[^=]+')
        OR (length(replace(x, ' ', '')) >= 4 AND len(regexp_extract_all(replace(x, ' ', ''), '<=|>=|!=|==|[=+\-*/^_<>]')) >= 2 AND length(regexp_replace(replace(x, ' ', ''), '[\p{L}\p{N}]', '', 'g')) >= 0.2 * length(replace(x, ' ', '')))
        OR (regexp_matches(x, '[\x{FFFD}\x{25A1}]') AND regexp_matches(x, '[A-Za-z0-9=+\-*/^_<>()\[\]{}]')))) > 0""".replace("TEXT", "t").replace("LATEX", ", ".join(f"'{m}'" for m in hints.LATEX))
_MIXED = r"CASE doc_id % 7 WHEN 0 THEN coalesce(text, '') || ' see \frac now' WHEN 1 THEN coalesce(text, '') || ' cost $ab$ each' WHEN 2 THEN coalesce(text, '') || chr(10) || 'x = y * z' WHEN 3 THEN coalesce(text, '') || ' see \[ab\] $$' WHEN 4 THEN coalesce(text, '') || chr(10) || '□ = ab' ELSE coalesce(text, '') END"


def _mixed(n):
    """A text as it is, or, for some rows, with a formula of some kind behind it."""
    text = F.coalesce("text", F.lit(""))
    tails = [r" see \frac now", " cost $ab$ each", "\nx = y * z", r" see \[ab\] $$", "\n□ = ab", "", ""]
    return F.concat(text, F.element_at(F.array(*map(F.lit, tails)), (n % 7 + 1).cast("int")))


@query(f"SELECT doc_id, {_FORMULA} AS formula FROM (SELECT doc_id, {_MIXED} AS t FROM documents)")
def formula_hint(spark, sf):
    """Whether texts hold formulas: whole documents, five in seven with a sign of one added."""
    return table(spark, sf, "documents").select("doc_id", hints.suggests_formula(_mixed(F.col("doc_id"))).alias("formula"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'picture' WHEN 1 THEN 'code' ELSE 'formula' END AS auto, CASE doc_id % 3 WHEN 0 THEN 'picture,table' WHEN 1 THEN 'code' ELSE 'formula' END AS every, CASE WHEN doc_id % 3 = 0 THEN 'picture' ELSE '' END AS images, doc_id % 3 <> 0 AS careful FROM documents""")
def asset_hints(spark, sf):
    """Kinds of assets that pages suggest, by mode, and which pages need the careful parser."""
    texts = ["one | two", "def solve(x):\n    return x\nclass A:", "E = m * c ^ 2"]
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % 3 + 1).cast("int"))
    image = F.col("doc_id") % 3 == 0
    kinds = {name: hints.asset_hints(text, image, mode) for name, mode in (("auto", "auto"), ("every", "all"), ("images", "images"))}
    pages = intake.hinted_pages(table(spark, sf, "documents").select("doc_id", *[v.alias(k) for k, v in kinds.items()]), "every")
    return pages.select("doc_id", *[F.array_join(k, ",").alias(k) for k in kinds], F.col("enriched").alias("careful"))


# --- texts as lines


@query(rf"""SELECT doc_id, md5({_STRIP.format("regexp_replace(array_to_string(list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: " + _RSTRIP.format("x") + "), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')").replace('{{3,}}', '{3,}')}) AS text FROM
    (SELECT doc_id, 'a  ' || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || replace(coalesce(text, ''), '. ', '. ' || chr(10) || chr(12288) || chr(10) || chr(10)) || chr(10) || 'end' AS text FROM documents)""")
def single_blank_lines(spark, sf):
    """Whole documents with blank lines of several kinds between their sentences."""
    body = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(". \n　\n\n"))
    return table(spark, sf, "documents").select("doc_id", F.md5(sections.single_blank_lines(F.concat(F.lit("a  \n\n \n\n"), body, F.lit("\nend")))).alias("text"))


@query(rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, ls, list_transform(ls, lambda x: {_PLAIN.format('x')}) AS ps, {_PLAIN.format("'3.2 ' || ls[len(ls) // 3 + 1]")} AS a, {_PLAIN.format("coalesce(ls[2 * len(ls) // 3 + 1], '')")} AS z, coalesce(ls[2 * len(ls) // 3 + 1], '') AS nxt FROM l),
    b AS (SELECT *, coalesce(list_position(list_transform(ps, lambda p: a <> '' AND (contains(p, a) OR (contains(a, p) AND p <> ''))), true), 0) AS i FROM n), c AS (SELECT *, CASE WHEN i > 0 THEN ls[i:] ELSE ls END AS kept, CASE WHEN i > 0 THEN ps[i:] ELSE ps END AS kps FROM b),
    d AS (SELECT *, CASE WHEN nxt <> '' THEN coalesce(list_position(list_transform(kps[2:], lambda p: z <> '' AND (contains(p, z) OR (contains(z, p) AND p <> ''))), true), 0) ELSE 0 END AS j FROM c)
    SELECT doc_id, md5({_STRIP.format("array_to_string(CASE WHEN j > 0 THEN kept[1:j] ELSE kept END, chr(10))")}) AS text FROM d""")
def heading_span(spark, sf):
    """The lines of every document from a line in its first third, named with a number before it, to one in its second."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").withColumn("ls", F.split("text", "\n"))
    at = lambda k: F.try_element_at("ls", (F.floor(F.size("ls") * k / 3) + 1).cast("int"))
    span = sections.heading_span(F.col("text"), F.concat(F.lit("3.2 "), at(1)), F.coalesce(at(2), F.lit("")), strict=True)
    return d.select("doc_id", F.md5(span).alias("text"))


@query(rf"""WITH t AS (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || '2.1 ') ELSE text END, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, ls, list_filter(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(trim(x), '^[0-9]+(?:\.[0-9]+)*[\s\x0B]+[A-Za-z][^\n.]{{2,}}$') AND NOT regexp_matches(lower(trim(x)), '^(?:\[begin lecture [^\]]+\]\s*)?\(?[0-9]+\)?$') THEN i END), lambda i: i IS NOT NULL) AS found FROM t)
    SELECT doc_id, md5({_STRIP.format("array_to_string(CASE WHEN len(found) >= 2 THEN ls[found[2]:] ELSE ls END, chr(10))")}) AS text FROM p""")
def front_matter(spark, sf):
    """Whole documents from their second numbered line on; in every second one all lines have numbers."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n2.1 "))).otherwise(F.col("text"))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5(sections.without_front_matter(text)).alias("text"))


@query(rf"""WITH t AS (SELECT doc_id, coalesce(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(string_split(text, chr(10))[1] || chr(10) || '12' || chr(10) || text || chr(10) || 'Contents ' || chr(10) || string_split(text, chr(10))[1], chr(10), chr(13) || chr(10)) ELSE text || chr(10) || 'foot' || chr(10) || ' foot' || chr(10) || chr(10) || 'foot  ' END, '') AS t FROM documents),
    l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)), lambda x: {_RSTRIP.format('x')}), lambda x: NOT (regexp_matches(trim(x), '^[0-9]{{1,4}}$') OR lower(trim(x)) IN ('contents', 'table of contents'))) AS ls FROM t),
    c AS (SELECT doc_id, ls, len(ls) AS n, list_transform(ls, lambda x: trim(x)) AS bs FROM l), d AS (SELECT *, len(list_filter(bs, lambda x: x = bs[1])) > 2 AS head, len(list_filter(bs, lambda x: x = bs[n])) - CASE WHEN len(list_filter(bs, lambda x: x = bs[1])) > 2 AND bs[1] = bs[n] THEN 1 ELSE 0 END > 2 AS foot FROM c)
    SELECT doc_id, md5({_STRIP.format("array_to_string(CASE WHEN n < 4 THEN ls ELSE list_filter(ls, lambda x, i: trim(x) <> '' AND NOT (i = 1 AND head) AND NOT (i = n AND foot)) END, chr(10))")}) AS text FROM d""")
def normal_pages(spark, sf):
    """Whole documents as pages: as they are, with a first line that stands there too often and page numbers, or with such a last line."""
    d, first = F.col("doc_id") % 3, F.element_at(F.split("text", "\n"), 1)
    busy = F.replace(F.concat(first, F.lit("\n12\n"), "text", F.lit("\nContents \n"), first), F.lit("\n"), F.lit("\r\n"))
    text = F.when(d == 0, F.col("text")).when(d == 1, busy).otherwise(F.concat("text", F.lit("\nfoot\n foot\n\nfoot  ")))
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.normalize_page(text)).alias("text"))


@query("""SELECT doc_id, ord::INT AS ord, number, title, page FROM (SELECT doc_id, 0 AS ord, '7.2' AS number, 'Changes ' || 'x' || doc_id AS title, (doc_id % 900 + 1)::BIGINT AS page FROM documents UNION ALL SELECT doc_id, 1, 'B', 'Plain entry', 12 FROM documents)""")
def toc_entries(spark, sf):
    d = F.col("doc_id")
    text = F.concat(F.lit("Table of Contents\n  7.2 Changes x"), d, F.lit(" . . . . "), (d % 900 + 1), F.lit("\nno entry\nB Plain entry  12\n3.1 99 .... 4"))
    return sections.toc_entries(table(spark, sf, "documents").select("doc_id", text.alias("text")))


@query(rf"SELECT doc_id, {_TITLE.format('t')} AS title, {_PLAIN.format('t')} AS plain FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '3.1  ' ELSE '' END || string_split(replace(text, 'fi', 'ﬁ'), chr(10))[1] || '  ' || (doc_id % 3000) AS t FROM documents WHERE text IS NOT NULL)")
def clean_titles(spark, sf):
    """First lines of all documents as titles, with ligatures, page numbers behind and, for some, section numbers before them."""
    d = F.col("doc_id")
    first = F.element_at(F.split(F.replace("text", F.lit("fi"), F.lit("ﬁ")), "\n"), 1)
    title = F.concat(F.when(d % 2 == 0, "3.1  ").otherwise(""), first, F.lit("  "), d % 3000)
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", tx.clean_title(title).alias("title"), tx.normalized_heading(title).alias("plain"))


@query("SELECT doc_id, contains(t, '[Vision Analysis]') OR contains(t, '[Page Image Analysis]') AS enriched FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), ' the ', ' [Vision Analysis] ') WHEN doc_id % 3 = 1 THEN replace(coalesce(text, ''), chr(10), '[Page Image Analysis]') ELSE replace(coalesce(text, ''), ' ', '[Image]') END AS t FROM documents)")
def enriched_texts(spark, sf):
    """Whole documents in which a frequent word, or the ends of lines, are marks."""
    d, text = F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    swap = lambda a, b: F.replace(text, F.lit(a), F.lit(b))
    given = F.when(d == 0, swap(" the ", " [Vision Analysis] ")).when(d == 1, swap("\n", "[Page Image Analysis]")).otherwise(swap(" ", "[Image]"))
    return table(spark, sf, "documents").select("doc_id", sections.is_enriched(given).alias("enriched"))


# --- sections

_SECTIONS = r"""h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, (turn * turn) % 4 AS level, 'Turn ' || turn || ' ' || role AS title, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^a-z]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM conversations),
    n AS (SELECT conv_id, count(*) AS n FROM h GROUP BY ALL), c AS (SELECT h.*, 'Chat ' || conv_id AS doc, (SELECT max(p.ord) FROM h p WHERE p.conv_id = h.conv_id AND p.ord < h.ord AND p.level < h.level) AS up, EXISTS (SELECT 1 FROM h x WHERE x.conv_id = h.conv_id AND x.ord = h.ord + 1 AND x.level > h.level) AS kids FROM h)"""
_KEY = "substr(sha1('doc' || chr(0) || doc), 1, 24)"
_TAGS = "list_filter(list_distinct(regexp_extract_all(lower(doc || ' ' || path), '[a-z][a-z0-9-]{2,}')), lambda w: w NOT IN ('and', 'for', 'the', 'with', 'from', 'into', 'this', 'that', 'lecture', 'optional', 'reading', 'section', 'summary'))"


def _chats(spark, sf):
    """Conversations as Markdown documents: a heading and a paragraph for each turn."""
    t = F.col("turn")
    body = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]+", " "), " +", " "))
    part = F.concat(F.repeat(F.lit("#"), ((t * t) % 4 + 1).cast("int")), F.lit(" Turn "), t, F.lit(" "), F.col("role"), F.lit("\n\n"), body)
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))).alias("ps"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("Chat "), "conv_id").alias("title"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n").alias("content"))


@query(rf"""WITH RECURSIVE {_SECTIONS}, p AS (SELECT conv_id, ord, title AS path FROM c WHERE up IS NULL UNION ALL SELECT c.conv_id, c.ord, p.path || ' > ' || c.title FROM c JOIN p ON p.conv_id = c.conv_id AND p.ord = c.up),
    b AS (SELECT c.*, p.path, {_KEY} AS key, substr(sha1('markdown' || chr(0) || doc || chr(0) || c.ord || chr(0) || c.title), 1, 24) AS node FROM c JOIN p ON p.conv_id = c.conv_id AND p.ord = c.ord),
    s AS (SELECT *, substr(sha1(key || chr(0) || 'summary' || chr(0) || node), 1, 24) AS own FROM b), u AS (SELECT s.*, coalesce(x.own, s.key) AS above FROM s LEFT JOIN s x ON x.conv_id = s.conv_id AND x.ord = s.up),
    leaf AS (SELECT *, repeat('#', level + 1) || ' ' || title AS head FROM u WHERE NOT kids),
    parts AS (SELECT *, CASE WHEN length(t) > 1600 THEN list_concat([head], list_transform(range(0, greatest(1, length(t) - 160)::BIGINT, 1440), lambda a: trim(substr(t, a + 1, 1600)))) WHEN t = '' THEN [head] WHEN length(head) + 2 + length(t) > 1600 THEN [head, t] ELSE [head || chr(10) || chr(10) || t] END AS cs FROM leaf),
    each AS (SELECT *, unnest(cs) AS part, unnest(range(0, len(cs))) AS pos FROM parts),
    chunks AS (SELECT substr(sha1(key || chr(0) || 'chunk' || chr(0) || node || chr(0) || pos), 1, 24) AS id, key AS doc_id, CASE WHEN level <= 1 THEN own ELSE above END AS parent_id, 'chunk' AS node_type, row_number() OVER (PARTITION BY conv_id ORDER BY ord, pos) - 1 AS chunk_index, path AS section_path,
      'Section: ' || path || chr(10) || 'Pages: ' || (ord + 1) || chr(10) || chr(10) || part AS content FROM each),
    sums AS (SELECT own AS id, key AS doc_id, above AS parent_id, 'section_summary' AS node_type, -1 AS chunk_index, path AS section_path, title || '. outline/heading-derived summary for ' || path || '. Pages ' || (ord + 1) || '. Tags: ' AS content FROM u WHERE level <= 1 OR kids),
    docs AS (SELECT any_value(key) AS id, any_value(key) AS doc_id, '' AS parent_id, 'document_summary' AS node_type, -1 AS chunk_index, any_value(doc) AS section_path, any_value(doc) || '. outline/heading-derived summary for ' || any_value(doc) || '. Pages ' || CASE WHEN count(*) = 1 THEN '1' ELSE '1-' || count(*) END || '. Tags: ' || chr(10) || chr(10) || 'Sections:' || chr(10) || string_agg('- ' || title, chr(10) ORDER BY ord) AS content FROM u GROUP BY conv_id)
    SELECT id, doc_id, parent_id, node_type, chunk_index, section_path, md5(content) AS content FROM (SELECT * FROM chunks UNION ALL SELECT * FROM sums UNION ALL SELECT * FROM docs)""")
def section_records(spark, sf):
    """Summary and chunk records of all conversations as Markdown documents (tags are compared by ``section_tag_lists``)."""
    got = sections.records(_chats(spark, sf))
    plain = F.when(F.col("node_type") == "chunk", F.col("content")).otherwise(F.regexp_replace("content", r"Tags: [^\n]*\.", "Tags: "))
    return got.select("id", "doc_id", "parent_id", "node_type", "chunk_index", "section_path", F.md5(plain).alias("content"))


@query(rf"""WITH RECURSIVE {_SECTIONS}, p AS (SELECT conv_id, ord, doc, title AS path FROM c WHERE up IS NULL UNION ALL SELECT c.conv_id, c.ord, c.doc, p.path || ' > ' || c.title FROM c JOIN p ON p.conv_id = c.conv_id AND p.ord = c.up),
    u AS (SELECT c.conv_id, c.ord, c.level, c.kids, p.doc, p.path FROM c JOIN p ON p.conv_id = c.conv_id AND p.ord = c.ord) SELECT path AS section_path, {_KEY} AS doc_id, array_to_string(list_sort({_TAGS}), ' ') AS tags FROM u WHERE level <= 1 OR kids""")
def section_tag_lists(spark, sf):
    got = sections.records(_chats(spark, sf)).where("node_type = 'section_summary'")
    return got.select("section_path", "doc_id", F.array_join(F.array_sort("tags"), " ").alias("tags"))


#: White space at either end, as Python strips it.
_ENDS = r"^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, 'ENDS', '', 'g')), lambda x: x <> '') AS ps FROM documents),
    f AS (SELECT doc_id, ps, 1 AS i, 0 AS chunk, '' AS held, NULL::VARCHAR AS closed FROM d UNION ALL
      SELECT doc_id, ps, i + 1, CASE WHEN length(held) > 0 AND (length(ps[i]) > 800 OR length(held) + 2 + length(ps[i]) > 800) THEN chunk + 1 ELSE chunk END + CASE WHEN length(ps[i]) > 800 THEN 1 ELSE 0 END,
        CASE WHEN length(ps[i]) > 800 THEN '' WHEN length(held) > 0 AND length(held) + 2 + length(ps[i]) <= 800 THEN held || chr(10) || chr(10) || ps[i] ELSE ps[i] END,
        CASE WHEN length(held) > 0 AND (length(ps[i]) > 800 OR length(held) + 2 + length(ps[i]) > 800) THEN held END FROM f WHERE i <= len(ps)),
    small AS (SELECT doc_id, closed AS content FROM f WHERE closed IS NOT NULL UNION ALL SELECT doc_id, held FROM f WHERE i > len(ps) AND held <> ''),
    big AS (SELECT doc_id, unnest(list_transform(range(0, (length(p) - 80)::BIGINT, 720), lambda a: regexp_replace(substr(p, a + 1, 800), 'ENDS', '', 'g'))) AS content FROM (SELECT doc_id, unnest(ps) AS p FROM d) WHERE length(p) > 800)
    SELECT doc_id, md5(content) AS content, count(*) AS n FROM (SELECT * FROM small UNION ALL SELECT * FROM big WHERE content <> '') GROUP BY ALL""".replace("ENDS", _ENDS))
def split_texts(spark, sf):
    """All documents packed into chunks of 800 characters, lines as paragraphs."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return sections.split_texts(d, 800, 80, separator="\n").groupBy("doc_id", F.md5("content").alias("content")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord, c_custkey % 3 AS level, c_custkey // 20 + 1 AS page_start FROM customer),
    n AS (SELECT a.doc_id, a.ord, a.page_start, min_by(b.page_start, b.ord) AS nxt FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND b.ord > a.ord AND b.level <= a.level GROUP BY ALL)
    SELECT doc_id, ord::INT AS ord, page_start, CASE WHEN nxt IS NULL THEN 500 ELSE greatest(page_start, nxt - 1) END AS page_end FROM n""".replace("min_by", "arg_min"))
def section_page_ends(spark, sf):
    from pyspark.sql import Window

    c = F.col("c_custkey")
    order = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    outline = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc_id"), order.alias("ord"), (c % 3).cast("int").alias("level"), F.concat(F.lit("t"), c).alias("title"), (F.floor(c / 20) + 1).alias("page_start"))
    return sections.with_page_ends(sections.section_tree(outline), F.lit(500)).select("doc_id", "ord", "page_start", "page_end")


@query(r"""WITH RECURSIVE b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, greatest(1, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))) AS c FROM conversations WHERE trim(text) <> ''),
    f AS (SELECT conv_id, i, [turn] AS held, [c] AS cs, NULL::BIGINT[] AS closed FROM b WHERE i = 1 UNION ALL SELECT conv_id, i, over_held, over_cs, closed FROM (
      SELECT f.conv_id, b.i, CASE WHEN list_sum(cs) + b.c > 60 THEN list_append(held[s:], b.turn) ELSE list_append(held, b.turn) END AS over_held, CASE WHEN list_sum(cs) + b.c > 60 THEN list_append(cs[s:], b.c) ELSE list_append(cs, b.c) END AS over_cs, CASE WHEN list_sum(cs) + b.c > 60 THEN held END AS closed
      FROM (SELECT *, least(len(cs), coalesce(list_min(list_filter(range(1, len(cs) + 1), lambda j: list_sum(cs[j:]) <= 10)), len(cs))) AS s FROM f) f JOIN b ON b.conv_id = f.conv_id AND b.i = f.i + 1)),
    last AS (SELECT conv_id, held AS closed, 1000000 AS i FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1), every AS (SELECT conv_id, closed, i FROM f WHERE closed IS NOT NULL UNION ALL SELECT * FROM last)
    SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INT AS chunk_no, array_to_string(closed, ',') AS turns FROM every""")
def block_packing(spark, sf):
    """Turns of all conversations packed into chunks of 60 words with an overlap of 10."""
    c = table(spark, sf, "conversations")
    b = c.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_num"), F.col("turn").alias("reading_order"), F.col("turn").alias("block_id"), F.col("role").alias("modality"), F.col("text").alias("content"))
    return blocks.pack_blocks(b, 60, 10).select("doc_id", "chunk_no", F.array_join(F.transform("block_ids", lambda x: x.cast("string")), ",").alias("turns"))


@query(r"""WITH f AS (SELECT doc_id, list_distinct(list_filter([trim(regexp_replace(coalesce(lang, ''), '\s+', ' ', 'g')), source, '', trim(regexp_replace(coalesce(lang, ''), '\s+', ' ', 'g'))], lambda x: x <> '')) AS fs FROM documents)
    SELECT doc_id, len(fs)::BIGINT AS forms FROM f""")
def block_forms(spark, sf):
    """How many distinct forms a block's content has."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit(" "), "lang").alias("markdown"), F.col("source").alias("latex"), F.lit(None).cast("string").alias("table_json"), F.concat("lang", F.lit("  ")).alias("text"))
    content = blocks.block_content()
    return d.select("doc_id", F.size(F.filter(F.split(content, " "), lambda x: x != "")).cast("long").alias("forms"))
