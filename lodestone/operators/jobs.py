"""Uploads and jobs as event logs: states, lists, recovery, cancelling, summaries.

Defined cases: null texts never match a search; a log without events gives no rows; of events of
one time the largest by all columns counts last; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import lifecycle
from lodestone.operators import records as rec

#: States of a job (fixed values).
ACTIVE = ("queued", "running", "paused_for_queries")
#: States in which an upload holds its place (fixed values).
BLOCKING = ("queued", "saving_uploads", "ingesting", "ingested", "indexed")
#: Kinds of trust entries (fixed values).
SOURCE_TYPES = ("unknown", "textbook", "research_paper", "lecture_notes", "student_project", "team_report", "standard", "web")


def job_page(jobs: DataFrame, search: str = "", offset: int = 0, limit: int = 10) -> DataFrame:
    """One page of jobs (id, status, phase, error, filenames, created_at), newest first, with ``total`` of
    those that match and ``active_count`` of all."""
    active = jobs.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("n")).scalar()
    wanted = search.strip().lower()
    texts = [F.col(c) for c in ("id", "status", "phase", "error")] + [F.array_join("filenames", ", ")]
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.contains(F.lower(F.coalesce(t, F.lit(""))), F.lit(wanted))
    found = jobs.where(hit) if wanted else jobs
    return rec.page(found, [F.desc("created_at"), F.col("id")], offset, limit, 100).withColumn("active_count", active)


def queue_counts(jobs: DataFrame) -> DataFrame:
    """One row: jobs in all, active ones, and those in each final state."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status").isin(*ACTIVE)).alias("active"), *[count(s) for s in lifecycle.TERMINAL])


def next_jobs(jobs: DataFrame, most: int = 100) -> DataFrame:
    """The next ``most`` queued jobs (id, kind, created_at) in the order in which they are run: questions
    first, then by age; ``writes`` marks those that wait for the one writer."""
    order = [F.when(F.col("kind") == "query", 0).otherwise(1), F.col("created_at"), F.col("id")]
    queued = jobs.where("status = 'queued'").select("id", "kind", "created_at", (F.col("kind") != "query").alias("writes"))
    return queued.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # ``most`` rows


def after_event(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Registry entries after one event each.

    ``entries(hash, job_id, status, previous)``, ``previous`` the status before a forced upload or null;
    ``events(hash, job_id, status)``, one for each hash. An event of another job than the entry's is
    ignored. A failure or interruption brings back the previous status where there is one, a failure
    leaves an entry that is ingested or indexed as it is, and an entry that becomes ingested or
    indexed forgets the previous one.
    """
    joined = entries.join(events.select("hash", F.col("job_id").alias("__job"), F.col("status").alias("__new")), "hash", "left")
    own = F.coalesce(F.col("__job") == F.col("job_id"), F.lit(False))
    broken = F.col("__new").isin("failed", "interrupted")
    done = F.col("status").isin("ingested", "indexed")
    status = (
        F.when(~own, F.col("status")).when((F.col("__new") == "failed") & done, F.col("status"))
        .when(broken & F.col("previous").isNotNull(), F.col("previous")).otherwise(F.col("__new"))
    )
    forget = own & F.col("__new").isin("ingested", "indexed")
    return joined.select("hash", "job_id", status.alias("status"), F.when(~forget, F.col("previous")).alias("previous"))


def ledger(log: DataFrame) -> DataFrame:
    """Jobs that a log of records and removals (job_id, seq, op, kind) holds: those whose last entry is a record."""
    last = log.groupBy("job_id").agg(F.max(F.struct("seq", "op", "kind")).alias("l"), F.min("seq").alias("first"))
    return last.where("l.op = 'record'").select("job_id", "l.kind", "first")


def cancelled(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs after a request to cancel some: queued ones are cancelled, running ones asked to stop, ended ones stay."""
    joined = jobs.join(wanted.select("id", F.lit(True).alias("__wanted")).distinct(), "id", "left")
    hit = F.coalesce("__wanted", F.lit(False))
    status = F.when(hit & F.col("status").isin("queued", "paused_for_queries"), "cancelled").when(hit & (F.col("status") == "running"), "cancelling").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("__wanted")


def staged_names(documents: DataFrame) -> DataFrame:
    """Adds ``staged_name`` to files (source_hash, filename, exists) that are taken in again: names are made
    unique by a number before the suffix; files that no longer exist are left out."""
    there = documents.where("exists")
    safe = tx.safe_component(tx.file_name(F.col("filename")), "document.pdf")
    named = there.withColumn("__safe", safe)
    number = F.row_number().over(Window.partitionBy(F.lower("__safe")).orderBy("source_hash"))
    stem, suffix = F.regexp_replace("__safe", r"\.[^.]*$", ""), F.regexp_extract("__safe", r"(\.[^.]*)$", 1)
    name = F.when(F.col("__n") == 1, F.col("__safe")).otherwise(F.concat(stem, F.lit("-"), F.col("__n"), suffix))
    return named.withColumn("__n", number).withColumn("staged_name", name).drop("__safe", "__n")


def trust_entry(entries: DataFrame) -> DataFrame:
    """Trust entries in normal form: unknown values take their defaults, texts are trimmed, weights follow from groups."""
    from lodestone.operators.retrieval import SOURCE_WEIGHTS, source_weight

    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    one_of = lambda c, known, default: F.when(text(c).isin(*known), text(c)).otherwise(default)
    group = F.when(F.lower(text("source_group")).isin(*SOURCE_WEIGHTS), F.lower(text("source_group"))).otherwise("ungrouped")
    return entries.select(
        "source_hash", one_of("review_status", lifecycle.REVIEW_STATUSES, "unreviewed").alias("review_status"), one_of("source_type", SOURCE_TYPES, "unknown").alias("source_type"),
        group.alias("source_group"), source_weight(group).alias("reliability_weight"), F.col("publication_year").cast("string").try_cast("int").alias("publication_year"),
        text("expires_at").alias("expires_at"), F.substring(text("reviewed_by"), 1, 80).alias("reviewed_by"), text("notes").alias("notes"),
    )


def trust_updates(entries: DataFrame, updates: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entries after the valid updates, report (source_hash, ok, problem) of all updates)."""
    checked = lifecycle.checked_trust(updates, groups)
    report = checked.select("source_hash", F.col("problem").isNull().alias("ok"), "problem")
    good = checked.where("problem IS NULL").select(*entries.columns)
    return lifecycle.upsert(entries, good, ["source_hash"]), report


def forced_cleanup(tables: dict[str, DataFrame], uploads: DataFrame) -> dict[str, DataFrame]:
    """Tables without what forced uploads (source_hash, forced) replace."""
    return lifecycle.cascade(tables, uploads.where("forced"))


def run_summary(log: DataFrame) -> DataFrame:
    """Per phase of a run log (phase, file, status, error, started, ended): files, failures, seconds, first errors."""
    wrong = F.slice(F.sort_array(F.collect_set(F.when(F.col("status") == "failed", F.concat_ws(": ", "file", "error")))), 1, 20)
    return log.groupBy("phase").agg(
        F.count_if(F.col("status") == "done").alias("files_processed"), F.count_if(F.col("status") == "failed").alias("files_failed"),
        F.round(F.max("ended") - F.min("started"), 3).alias("elapsed_s"), wrong.alias("errors"),
    )


def resumable(inputs: DataFrame, checkpoint: DataFrame) -> Column:
    """One value: whether all that a checkpoint (name) has completed is still among the inputs (name)."""
    return checkpoint.join(inputs.select("name"), "name", "left_anti").agg((F.count(F.lit(1)) == 0).alias("ok")).scalar()


def unseen(requested: DataFrame, seen: DataFrame) -> DataFrame:
    """Requested sources that no file has given: their records go."""
    return requested.select("source_hash").distinct().join(seen.select("source_hash"), "source_hash", "left_anti")


def progress_line(events: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Progress rows (phase, done, total, unit, rate_per_min, eta_seconds) as lines; nulls and extras with reserved names are left out."""
    from lodestone.streaming.incremental import PROGRESS_MARK

    reserved = ["phase", "done", "total", "unit", "rate_per_min", "eta_seconds"]
    names = [c for c in [*reserved, *(e for e in extra or [] if e not in reserved)] if c in events.columns]
    return events.select(F.concat(F.lit(PROGRESS_MARK), F.to_json(F.struct(*names))).alias("value"))
