"""Operators on index records: search, paging, replacement, overrides, reuse, manifest, hierarchy.

A record has the columns of ``RECORD``; a missing column takes its default in ``conform``.

Defined cases: null texts never match a search and count no characters; rows with a null key stay
where rows are deleted or replaced by key; ties go by id; repeated rows count as often as they
stand; empty tables give empty results (and totals of 0); further columns ride along. A page needs
a column name ``total`` of its own: one that the rows have is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.vectors import fit_dimension
from lodestone.operators import trees
from lodestone.sources.staging import discard, stage

#: Columns of an index record and their defaults (fixed values).
RECORD = {
    "id": ("string", ""), "doc_id": ("string", ""), "parent_id": ("string", ""), "node_type": ("string", "chunk"),
    "file_path": ("string", ""), "chunk_index": ("long", -1), "content": ("string", ""), "title": ("string", ""),
    "section_path": ("string", ""), "page_start": ("long", 0), "page_end": ("long", 0), "summary": ("string", ""),
    "tags": ("array<string>", None), "source_hash": ("string", ""), "source_pdf_name": ("string", ""), "source_pdf_path": ("string", ""),
    "embedding_model": ("string", ""), "embedding_dim": ("long", 0),
}
SEARCHED = ["id", "content", "title", "section_path", "summary", "file_path", "source_hash", "source_pdf_name", "source_pdf_path", "doc_id"]


def conform(records: DataFrame, model: str = "", dim: int | None = None) -> DataFrame:
    """The record columns with defaults and types; a vector is cut or padded to the dimension."""
    given = set(records.columns)
    out: dict[str, Column] = {}
    for name, (kind, default) in RECORD.items():
        value = F.col(name).cast(kind) if name in given else F.lit(None).cast(kind)
        out[name] = F.coalesce(value, F.array().cast(kind) if default is None else F.lit(default).cast(kind))
    if dim is not None:
        vector = F.col("vector").cast("array<float>") if "vector" in given else F.lit(None).cast("array<float>")
        out |= {"embedding_model": F.lit(model), "embedding_dim": F.lit(dim).cast("long")}
        out["vector"] = fit_dimension(F.coalesce(vector, F.array().cast("array<float>")), dim)
    return records.select(*[c.alias(name) for name, c in out.items()])


def matches(search: str, columns: list[str] | None = None, tags: str | None = "tags") -> Column:
    """Case-insensitive search over the text columns and the tags; % and _ mean themselves."""
    parts = [F.col(c) for c in columns or SEARCHED]
    if tags:
        parts.append(F.array_join(tags, " "))
    return F.lower(F.concat_ws("\n", *parts)).contains(search.strip().lower())


def page(rows: DataFrame, order: list[Column], offset: int, limit: int, most: int = 200) -> DataFrame:
    """One page of rows in an order, the limit held to 1..most, with the total as a column."""
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    size = max(1, min(int(limit), most))
    return rows.orderBy(*order).offset(max(0, int(offset))).limit(size).withColumn("total", total)


def of_source(hashes: list[str], paths: list[str] | None = None, docs: list[str] | None = None) -> Column:
    """Whether a record belongs to a source: by hash, or by path or document for records without one."""
    variants = {v for p in paths or [] for v in (p, p.replace("\\", "/"), p.replace("/", "\\"))}
    out = F.col("source_hash").isin(*hashes) if hashes else F.lit(False)
    if variants:
        out = out | F.col("file_path").isin(*sorted(variants)) | F.col("source_pdf_path").isin(*sorted(variants))
    return out | F.col("doc_id").isin(*docs) if docs else out


def replace_by_key(table: DataFrame, new: DataFrame, key: str = "source_hash") -> DataFrame:
    """The table with all rows of the new rows' keys replaced; doing it again changes nothing."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*table.columns))


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def apply_overrides(records: DataFrame, edits: DataFrame, deletions: DataFrame) -> DataFrame:
    """Deleted ids go, edited contents replace, and ``edited`` tells which."""
    changed = edits.select("id", F.col("content").alias("__content"))
    kept = records.join(deletions.select("id"), "id", "left_anti").join(changed, "id", "left")
    return kept.withColumns({"edited": F.col("__content").isNotNull(), "content": F.coalesce("__content", "content")}).drop("__content")


def reuse_vectors(new: DataFrame, old: DataFrame, model: str, dim: int) -> DataFrame:
    """New records with the old vector where id, content, model and dimension are the same; else null."""
    usable = old.where((F.col("embedding_model") == model) & (F.size("vector") == dim))
    known = usable.select("id", tx.content_hash(F.col("content")).alias("__hash"), F.col("vector"))
    joined = new.drop("vector").withColumn("__hash", tx.content_hash(F.col("content"))).join(known, ["id", "__hash"], "left")
    return joined.withColumn("reused", F.col("vector").isNotNull()).drop("__hash")


def manifest_key() -> Column:
    """A record's source: its hash, else the path of its source or file, else its document."""
    filled = [F.nullif(F.trim(c), F.lit("")) for c in ("source_hash", "source_pdf_path", "file_path", "doc_id")]
    return F.coalesce(*filled, F.lit("unknown"))


def manifest(records: DataFrame) -> DataFrame:
    """Per source: names (those of its first record by id), counts of records, chunks and summaries,
    characters, the range of pages, and, with a column ``reused``, how many vectors are new and reused."""
    first = lambda c: F.min_by(F.coalesce(c, F.lit("")), "id").alias(c)
    known = F.coalesce("reused", F.lit(False)) if "reused" in records.columns else F.lit(False)
    return records.groupBy(manifest_key().alias("source_key")).agg(
        *map(first, ("source_hash", "source_pdf_name", "source_pdf_path", "file_path")),
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(F.col("node_type") == "chunk").alias("chunk_count"),
        F.count_if(F.col("node_type").endswith("summary")).alias("summary_count"),
        F.count_if(~known).alias("embedded_count"),
        F.count_if(known).alias("reused_count"),
        F.sum(F.length("content")).alias("content_char_count"),
        F.coalesce(F.min(F.nullif("page_start", F.lit(0))), F.lit(0)).cast("long").alias("page_start"),
        F.coalesce(F.max("page_end"), F.lit(0)).cast("long").alias("page_end"),
    )


def manifest_totals(entries: DataFrame) -> DataFrame:
    """One row of totals of a manifest. Documents whose vectors were all reused count none as embedded."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return entries.agg(F.count(F.lit(1)).alias("documents"), total("record_count").alias("total_records"), total("embedded_count").alias("embedded_records"), total("reused_count").alias("reused_records"))


def manifest_stats(documents: DataFrame, entries: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Documents with the ``columns`` of the manifest entry that the first matching one of several keys names."""
    out = documents
    for i, key in enumerate(keys):
        entry = entries.select(F.col("source_key").alias(f"__key{i}"), F.struct(*columns).alias(f"__entry{i}"))
        out = out.join(entry, F.col(key) == F.col(f"__key{i}"), "left")
    held = F.coalesce(*[F.col(f"__entry{i}") for i in range(len(keys))])
    return out.select(*documents.columns, *[held[c].alias(c) for c in columns])


def table_metadata(records: DataFrame, model: str = "nomic-embed-text", dim: int = 768) -> DataFrame:
    """One row: model and dimension of the first record by id; the defaults for an empty table."""
    first = records.agg(F.min(F.struct("id", "embedding_model", "embedding_dim")).alias("r"))
    return first.select(F.coalesce(F.nullif("r.embedding_model", F.lit("")), F.lit(model)).alias("embedding_model"), F.coalesce(F.nullif("r.embedding_dim", F.lit(0)), F.lit(dim)).cast("long").alias("embedding_dim"))


def update_manifest(old: DataFrame, records: DataFrame) -> DataFrame:
    """A manifest with the entries of the given records' sources made anew."""
    return replace_by_key(old, manifest(records), "source_key")


def index_order() -> list[Column]:
    """Source, section, kind of node, chunk number, id."""
    kind = F.when(F.col("node_type") == "document_summary", 0).when(F.col("node_type") == "section_summary", 1).when(F.col("node_type") == "chunk", 2).otherwise(3)
    return [F.coalesce(F.nullif("source_pdf_name", F.lit("")), "file_path"), F.col("section_path"), kind, F.coalesce("chunk_index", F.lit(-1)), F.col("id")]


def top_rows(records: DataFrame) -> DataFrame:
    """Document summaries; without any, summaries without a parent summary; then records without a parent; then all rows."""
    summary = F.col("node_type").isin("document_summary", "section_summary")
    parents = records.where(summary).select(F.col("id").alias("__parent")).distinct()
    marked = records.join(parents, F.col("parent_id") == F.col("__parent"), "left")
    rank = (
        F.when(F.col("node_type") == "document_summary", 0)
        .when(summary & F.col("__parent").isNull(), 1)
        .when(F.coalesce("parent_id", F.lit("")) == "", 2)
        .otherwise(3)
    )
    ranked = marked.withColumn("__rank", rank)
    return ranked.where(F.col("__rank") == ranked.agg(F.min("__rank").alias("r")).scalar()).drop("__rank", "__parent")


def descendants(edges: DataFrame) -> DataFrame:
    """All (ancestor, node, depth) of a forest of edges (parent, node), nearest depth, safe against cycles.

    Paths double in length each round, so a deep tree takes few joins. Each round is staged in the
    shared folder; the rounds end when no pair is new.
    """
    known = edges.select(F.col("parent").alias("ancestor"), "node", F.lit(1).alias("depth")).where("ancestor <> node").distinct()
    size = -1
    while True:
        more = known.alias("a").join(known.alias("b").hint("merge"), F.col("a.node") == F.col("b.ancestor"))
        more = more.select(F.col("a.ancestor").alias("ancestor"), F.col("b.node").alias("node"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        joined = known.unionByName(more.where("ancestor <> node"))
        before, known = known, stage(joined.groupBy("ancestor", "node").agg(F.min("depth").alias("depth")), "descendants")
        if size >= 0:
            discard(before)
        now = known.count()
        if now == size:
            return known
        size = now


def node_counts(edges: DataFrame) -> DataFrame:
    """Per node with something below it: direct children and all descendants, as differences of interval labels.

    Nodes on a cycle or below one have no label; theirs are counted from pairs.
    """
    found = trees.labels(edges)
    if found.cyclic.isEmpty():
        return trees.counts(found)
    below = descendants(edges.join(found.cyclic, "node", "left_semi"))
    rest = below.groupBy(F.col("ancestor").alias("node")).agg(F.count_if(F.col("depth") == 1).alias("child_count"), F.count(F.lit(1)).alias("descendant_count"))
    return trees.counts(found).unionByName(rest)


def below_sums(records: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Per record sums of some values over all records below it, by ``parent_id``: (id, *values).

    A parent that is no record passes its children's sums on to nobody. Records on a cycle, or below one,
    have the sums of the pairs.
    """
    given = records.select("id", "parent_id", *[v.cast("long").alias(n) for n, v in values.items()])
    each = given.groupBy(F.col("id").alias("node")).agg(F.max(F.nullif("parent_id", F.lit(""))).alias("parent"), *[F.sum(n).alias(n) for n in values]).where("node IS NOT NULL")
    tree = each.withColumn("parent", F.when(F.col("parent") != F.col("node"), F.col("parent")))
    known = tree.select(F.col("node").alias("parent")).withColumn("__known", F.lit(True))
    tree = stage(tree.join(known, "parent", "left").withColumn("parent", F.when(F.col("__known"), F.col("parent"))).drop("__known"), "tree")
    sums, cyclic = trees.subtree_sums(tree, list(values))
    own = tree.select("node", *[F.col(n).alias(f"__{n}") for n in values])
    out = sums.join(own, "node").select(F.col("node").alias("id"), *[(F.col(n) - F.col(f"__{n}")).alias(n) for n in values])
    if cyclic.isEmpty():
        return out
    pairs = descendants(tree.join(cyclic, "node", "left_semi").where("parent IS NOT NULL").select("parent", "node"))
    rest = pairs.join(tree.drop("parent"), "node").groupBy(F.col("ancestor").alias("id")).agg(*[F.sum(n).alias(n) for n in values])
    return out.unionByName(rest)


def summaries_matching(rows: DataFrame, search: str) -> DataFrame:
    """Summary records that match a search themselves or through a record below them.

    Below a document summary are all records of its document, below others their descendants.
    """
    hits = rows.where(matches(search)).select("id", "doc_id")
    over = below_sums(rows, {"hits": matches(search)}).where("hits > 0").select("id")
    docs = hits.select("doc_id").distinct().withColumn("node_type", F.lit("document_summary"))
    summary = rows.where(F.col("node_type") != "chunk")
    by_id = summary.join(hits.select("id").unionByName(over).distinct(), "id", "left_semi")
    by_doc = summary.join(docs, ["doc_id", "node_type"], "left_semi").select(*rows.columns)
    return by_id.unionByName(by_doc.join(by_id.select("id"), "id", "left_anti").select(*by_id.columns))


def public_rows(records: DataFrame) -> DataFrame:
    """Records as they are shown: without vector and with their number of characters."""
    return records.drop("vector").withColumn("char_count", F.length(F.coalesce("content", F.lit(""))).cast("long"))


def of_node(records: DataFrame, parent: dict | None) -> DataFrame:
    """Records below one node (id, doc_id, node_type): all others of its document below a document summary, else its descendants."""
    if parent is None:
        raise KeyError("no such node")
    if parent["node_type"] == "document_summary":
        return records.where((F.col("doc_id") == parent["doc_id"]) & (F.col("id") != parent["id"]))
    edges = records.where(F.col("doc_id") == parent["doc_id"]).where("parent_id <> ''").select(F.col("parent_id").alias("parent"), F.col("id").alias("node"))
    found = trees.labels(edges)
    own = found.rows.where(F.col("node") == parent["id"]).first()
    if own is not None:
        below = found.rows.where((F.col("top") == own["top"]) & F.col("pre").between(own["pre"] + 1, own["last"]))
    else:  # on a cycle, or without anything below
        below = descendants(edges.join(found.cyclic, "node", "left_semi")).where(F.col("ancestor") == parent["id"])
    return records.join(below.select(F.col("node").alias("id")), "id", "left_semi")


def child_page(records: DataFrame, parent_id: str, offset: int = 0, limit: int = 100, search: str = "", most: int = 500) -> DataFrame:
    """One page of the records below a node, in index order, with ``total`` and ``node_level``; KeyError without the node."""
    found = records.where(F.col("id") == parent_id).select("id", "doc_id", "node_type", "section_path").first()
    parent = found.asDict() if found else None
    below = of_node(records, parent)
    if search.strip():
        below = below.where(matches(search))
    return page(below.withColumn("node_level", node_level(F.col("section_path"), F.lit(parent["section_path"]))), index_order(), offset, limit, most)


def node_level(path: Column, parent_path: Column, most: int = 6) -> Column:
    """How many sections below its parent a record stands, 1 at least and 1 where the paths part."""
    parts = lambda p: F.filter(F.transform(F.split(F.coalesce(p, F.lit("")), ">"), lambda x: F.trim(x)), lambda x: x != "")
    own, above = parts(path), parts(parent_path)
    inside = (F.size(above) > 0) & (F.slice(own, F.lit(1), F.size(above)) == above)
    return F.least(F.lit(most), F.when(inside, F.greatest(F.lit(1), F.size(own) - F.size(above))).otherwise(1))


def hierarchy(records: DataFrame, search: str = "") -> DataFrame:
    """Per summary: all records below it, how many are summaries, and how many chunks.

    With a search only records that match count. Below a document summary are all others of its document.
    """
    seen = records.where(matches(search)) if search.strip() else records
    row = seen.select(F.col("id").alias("node"), "doc_id", (F.col("node_type") == "chunk").alias("chunk"))
    tops = records.where("node_type = 'document_summary'").select("id", "doc_id")
    of_doc = tops.join(row, "doc_id").where("id <> node").groupBy("id").agg(F.count(F.lit(1)).alias("child_count"), F.count_if("chunk").alias("detail_count"))
    hit = F.coalesce(matches(search), F.lit(False)) if search.strip() else F.lit(True)
    sums = below_sums(records, {"child_count": hit, "detail_count": hit & (F.col("node_type") == "chunk")})
    others = records.where("node_type = 'section_summary'").select("id").distinct()
    counted = of_doc.unionByName(sums.join(others, "id", "left_semi")).withColumn("summary_count", F.col("child_count") - F.col("detail_count"))
    summaries = records.where("node_type IN ('document_summary', 'section_summary')").select("id")
    zero = F.lit(0).cast("long")
    return summaries.join(counted, "id", "left").select("id", *[F.coalesce(c, zero).alias(c) for c in ("child_count", "summary_count", "detail_count")])


def known_sources(lists: list[DataFrame], key: str = "source_hash") -> DataFrame:
    """Distinct source hashes in the order in which they are first seen: (source_hash, place).

    Each list has a column ``seq``; the lists follow each other.
    """
    parts = [x.where(F.coalesce(F.col(key), F.lit("")) != "").select(key, F.struct(F.lit(i).alias("list"), F.col("seq").cast("long").alias("seq")).alias("at")) for i, x in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = every.groupBy(key).agg(F.min("at").alias("at"))
    lower = first.groupBy("at.list").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("list", "__list")
    before = lower.select("__list", (F.sum("n").over(Window.orderBy("__list")) - F.col("n")).alias("before"))  # a row for each list
    place = F.row_number().over(Window.partitionBy("at.list").orderBy("at.seq", key))
    return first.withColumn("__place", place).join(F.broadcast(before), F.col("at.list") == F.col("__list")).select(key, (F.col("__place") + F.col("before")).alias("place"))


def event_stream(records: DataFrame, search: str = ""):
    """An index as events: its metadata, its rows in order, one by one, and at last how many came.

    Rows leave partition by partition, so the driver holds one partition at a time.
    """
    seen = public_rows(records.where(matches(search)) if search.strip() else records)
    total = seen.count()
    yield {"type": "metadata", "total": total}
    received = 0
    for row in seen.orderBy(*index_order()).toLocalIterator(prefetchPartitions=True):
        received += 1
        yield {"type": "row", "row": row.asDict(recursive=True)}
    yield {"type": "done", "received": received, "total": total}


def changed_row(table: DataFrame, record_id: str, content: str, embed, model: str, dim: int) -> DataFrame:
    """The table with one record's content, vector and model changed; other rows keep theirs.

    ``embed`` makes a column of vectors from a column of texts.
    """
    hit = F.col("id") == record_id
    row = table.where(hit).withColumns({"content": F.lit(content), "vector": fit_dimension(embed(F.lit(content)), dim), "embedding_model": F.lit(model), "embedding_dim": F.lit(dim).cast("long")})
    return table.where(~hit | F.col("id").isNull()).unionByName(row.select(*table.columns))


def with_edit(edits: DataFrame, deletions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides after some edits (columns of ``edits``): each replaces an edit of its id and takes a deletion back."""
    wanted = new.where(F.coalesce(F.col("record_id").cast("string"), F.lit("")) != "")
    kept = edits.join(wanted.select("record_id"), "record_id", "left_anti")
    return kept.unionByName(wanted.select(*edits.columns)), deletions.join(wanted.select("record_id"), "record_id", "left_anti")


def with_deletions(edits: DataFrame, deletions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides after some deletions (columns of ``deletions``): each takes an edit of its id back."""
    wanted = gone.where(F.coalesce(F.col("record_id").cast("string"), F.lit("")) != "")
    kept = deletions.join(wanted.select("record_id"), "record_id", "left_anti")
    return edits.join(wanted.select("record_id"), "record_id", "left_anti"), kept.unionByName(wanted.select(*deletions.columns))


def without_sources(overrides: DataFrame, hashes: DataFrame) -> DataFrame:
    """Overrides without those of some sources."""
    return overrides.join(hashes.select("source_hash").where(F.col("source_hash").cast("string") != "").distinct(), "source_hash", "left_anti")


def newest(table: DataFrame, key: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The newest rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return table.withColumn("__k", rank).where(F.col("__k") <= keep).drop("__k")
