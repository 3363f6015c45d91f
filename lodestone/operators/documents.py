"""Document management: trust, quality, registry states, duplicates, recovery, answers' citations.

Defined cases: null statuses count as unreviewed, null dates never expire; a null or empty text has
no marks and no claims; keys that are null match nothing; of rows with equal order the largest
key counts as last; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

#: Order of the states of an upload (fixed values).
STATES = ["queued", "saving_uploads", "ingesting", "ingested", "indexing", "indexed", "failed", "interrupted", "superseded"]


def trust_warnings(now: Column) -> Column:
    """Warnings from review_status and expires_at; a date alone expires at its end."""
    status = F.coalesce(F.nullif("review_status", F.lit("")), F.lit("unreviewed"))
    stated = F.when(F.col("expires_at").contains("T"), F.col("expires_at")).otherwise(F.concat("expires_at", F.lit("T23:59:59Z")))
    expiry = F.when(F.trim("expires_at") != "", F.try_to_timestamp(stated))
    return F.array_compact(
        F.array(
            F.when(status == "unreviewed", "unreviewed_source"),
            F.when(status == "rejected", "rejected_source"),
            F.when(status == "stale", "marked_stale"),
            F.when(expiry < now, "review_expired"),
        )
    )


def markdown_counts(text: Column) -> dict[str, Column]:
    body = F.coalesce(text, F.lit(""))
    count = lambda mark: ((F.length(body) - F.length(F.replace(body, F.lit(mark), F.lit("")))) / len(mark)).cast("long")
    return {
        "markdown_char_count": F.length(F.regexp_replace(body, r"^[\s]+|[\s]+$", "")).cast("long"),
        "page_markers": F.regexp_count(body, F.lit(r"(?m)^##\s+Page\s+\d+")).cast("long"),
        "enrichment_markers": count("[Vision Analysis]") + count("[Page Image Analysis]"),
        "table_markers": count("|"),
        "equation_markers": F.regexp_count(body, F.lit(r"(?<!\\)\$[^$\n]{1,160}(?<!\\)\$")).cast("long"),
    }


def quality_warnings(warnings: Column) -> Column:
    """Warnings of a document from its markdown, state and manifest, then those of its trust entry."""
    own = F.array_compact(
        F.array(
            F.when(F.col("markdown_char_count").isNull(), "missing_markdown").when(F.col("markdown_char_count") < 500, "low_extracted_text"),
            F.when(F.col("status") != "indexed", "not_indexed"),
            F.when(F.col("status") == "interrupted", "job_interrupted"),
            F.when(F.col("chunk_count").isNull(), "missing_index_manifest").when(F.col("chunk_count") <= 0, "no_chunks"),
        )
    )
    return F.concat(own, warnings)


def quality_label(warnings: Column) -> Column:
    blocking = F.arrays_overlap(warnings, F.array(*map(F.lit, ("not_indexed", "no_chunks", "rejected_source"))))
    return F.when(F.size(warnings) == 0, "ready").when(blocking, "not_ready").otherwise("review")


def latest_state(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key in an event log, reduced in map tasks."""
    last = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("last")
    return events.groupBy(key).agg(last).select(key, *[F.col(f"last.{c}").alias(c) for c in columns])


def recovery_jobs(registry: DataFrame, states: list[str] = STATES) -> DataFrame:
    """Jobs to resume: the earliest state of each and the number of its uploads."""
    rank = F.array_position(F.array(*map(F.lit, states)), F.col("status")).cast("int")
    return registry.groupBy("job_id").agg(F.min(rank).alias("rank"), F.count(F.lit(1)).alias("uploads")).withColumn("resume_at", F.element_at(F.array(*map(F.lit, states)), F.col("rank")))


def supersede(registry: DataFrame, path: str, order: list[str], key: str) -> DataFrame:
    """Adds ``active``: whether a row is the last one of its processed path."""
    last = Window.partitionBy(path).orderBy(*[F.desc(c) for c in order], F.desc(key))
    return registry.withColumn("active", F.row_number().over(last) == 1)


def first_match(wanted: DataFrame, key: str, stores: list[tuple[str, DataFrame]]) -> DataFrame:
    """Where each key is found first, in the order of the stores; keys found nowhere are left out."""
    parts = [store.select(key, F.lit(i).alias("rank"), F.lit(name).alias("found_in")).distinct() for i, (name, store) in enumerate(stores)]
    every = wanted.select(key).distinct().join(reduce(DataFrame.unionByName, parts), key)
    return every.groupBy(key).agg(F.min_by("found_in", "rank").alias("found_in"))


def weak_claims(answers: DataFrame, sources: DataFrame, least_words: int = 4, least_share: float = 0.25) -> DataFrame:
    """Claims with citations whose sources hold too few of their keywords.

    ``answers(answer_id, text)``, ``sources(answer_id, label, content)``. Rows (answer_id,
    fragment_no, label, share).
    """
    fragments = answers.select("answer_id", F.posexplode(tx.claim_fragments(F.col("text"))).alias("fragment_no", "fragment"))
    words = fragments.withColumn("words", tx.keywords(F.col("fragment")))
    cited = words.withColumn("label", F.explode(F.array_distinct(tx.citation_labels(F.col("fragment"))))).where(F.size("words") >= least_words)
    met = cited.join(sources, ["answer_id", "label"])
    body = F.lower("content")
    held = F.size(F.filter("words", lambda w: F.contains(body, w)))
    share = met.withColumn("share", held / F.size("words"))
    best = share.groupBy("answer_id", "fragment_no").agg(F.max("share").alias("share"), F.sort_array(F.collect_set("label")).alias("labels"))
    return best.where(F.col("share") < least_share)


def unknown_citations(answers: DataFrame, valid: DataFrame) -> DataFrame:
    """Labels that an answer cites and that its sources don't have."""
    cited = answers.select("answer_id", F.explode(F.array_distinct(tx.citation_labels(F.col("text")))).alias("label"))
    return cited.join(valid.select("answer_id", "label"), ["answer_id", "label"], "left_anti")


def listing(registry: DataFrame, source_map: DataFrame, manifests: DataFrame, trust: DataFrame) -> DataFrame:
    """The list of documents: what registry or source map know of a source, with its manifest and trust.

    ``registry(source_hash, filename, status)``, ``source_map(source_hash, filename)``. A source
    that only the map knows counts as ingested, one whose manifest has chunks as indexed. Ungrouped
    sources come first, then the order of names.
    """
    known = registry.select("source_hash", F.col("filename").alias("__r"), "status").join(source_map.select("source_hash", F.col("filename").alias("__m")), "source_hash", "full")
    joined = known.join(manifests, "source_hash", "left").join(trust, "source_hash", "left")
    state = F.when(F.coalesce("chunk_count", F.lit(0)) > 0, "indexed").otherwise(F.coalesce("status", F.lit("ingested")))
    group = F.coalesce("source_group", F.lit("ungrouped"))
    out = joined.select("source_hash", F.coalesce("__r", "__m").alias("filename"), state.alias("status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), group.alias("source_group"))
    return out.orderBy(F.when(F.col("source_group") == "ungrouped", 0).otherwise(1), "filename", "source_hash")
