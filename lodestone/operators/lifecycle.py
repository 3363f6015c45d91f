"""Tables that follow a document's life: upserts, ledgers, cascading deletes, assets, trust entries.

Defined cases: rows with a null key are never deleted by key; null texts mention no asset; of several
new rows with one key the largest by all columns counts; empty tables change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled", "interrupted")
REVIEW_STATUSES = ("unreviewed", "approved", "rejected", "stale")
MARKER = r"\[\[image:([A-Za-z0-9_.-]+)\]\]"


def upsert(table: DataFrame, new: DataFrame, key: list[str], update: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` put into ``table``: known keys take the updated columns, unknown ones are added.

    Of several new rows with one key the largest by all columns counts. ``update``: the columns
    that a known row takes; all by default.
    """
    columns = table.columns
    last = new.groupBy(*key).agg(F.max(F.struct(*[c for c in columns if c not in key])).alias("__new"))
    take = set(update or columns)
    joined = table.withColumn("__old", F.lit(True)).join(last, key, "full")
    out = [F.col(c) if c in key else F.when(F.col("__new").isNotNull() & (F.col("__old").isNull() | F.lit(c in take)), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return joined.select(*out)


def pending(ledger: DataFrame) -> DataFrame:
    """Entries of an event log (job_id, status, recorded_at) whose last event is no terminal one, oldest first."""
    last = ledger.groupBy("job_id").agg(F.max_by("status", F.struct("recorded_at", "status")).alias("status"), F.min("recorded_at").alias("recorded_at"))
    return last.where(~F.col("status").isin(*TERMINAL)).orderBy("recorded_at", "job_id")


def status_counts(jobs: DataFrame) -> DataFrame:
    """How many jobs are in each state."""
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "source_hash") -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    keys = gone.select(key).distinct()
    return {name: t.join(keys, key, "left_anti") for name, t in tables.items()}


def shared_paths(documents: DataFrame, gone: DataFrame, path: str = "path", key: str = "source_hash") -> DataFrame:
    """Paths of deleted documents that no other document uses: these files can go."""
    kept = documents.join(gone.select(key).distinct(), key, "left_anti").select(path).distinct()
    return documents.join(gone.select(key).distinct(), key).select(path).distinct().join(kept, path, "left_anti")


def assets_in(texts: DataFrame, assets: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """Known assets that texts mention, each once, in the order of its first mention: (id, place, asset_id, ...)."""
    found = texts.select(F.col(id_col).alias("id"), F.posexplode(F.array_distinct(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(MARKER), F.lit(1)))).alias("place", "asset_id"))
    return found.join(assets, "asset_id")


def add_assets(assets: DataFrame, new: DataFrame) -> DataFrame:
    """Assets by their content's id: a known id keeps its first entry."""
    first = Window.partitionBy("asset_id").orderBy("created_at", *[c for c in assets.columns if c not in ("asset_id", "created_at")])
    return assets.unionByName(new.select(*assets.columns)).withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def save_images(images: DataFrame, folder: str) -> DataFrame:
    """Write images (source_hash, page_no, description, data) under names made of their content; their entries.

    An image that comes again is written to the same name with the same bytes, so tasks may be repeated.
    """
    name = asset_id(F.col("source_hash"), F.coalesce("page_no", F.lit(0)), F.col("data"))
    key = F.coalesce(F.nullif("source_hash", F.lit("")), F.lit("unknown-source"))
    rows = images.where("data IS NOT NULL").select(name.alias("asset_id"), "source_hash", F.coalesce("page_no", F.lit(0)).cast("long").alias("page_no"), "description", F.concat(key, F.lit("/"), name, F.lit(".png")).alias("relative_path"), "data")

    def run(batches):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, data in zip(b.column("relative_path").to_pylist(), b.column("data"), strict=True):
                store.create_dir(f"{at}/{path.rsplit('/', 1)[0]}", recursive=True)
                with store.open_output_stream(f"{at}/{path}", compression=None) as out:
                    out.write(data.as_buffer())
            yield b.select(["asset_id", "source_hash", "page_no", "description", "relative_path"])

    return rows.mapInArrow(run, "asset_id string, source_hash string, page_no long, description string, relative_path string")


def linked(assets: DataFrame, links: DataFrame) -> DataFrame:
    """Assets (asset_id, block_id, ...) with the block that ``links(asset_id, block_id)`` names, where it names one."""
    new = links.groupBy("asset_id").agg(F.max("block_id").alias("__block"))
    return assets.join(new, "asset_id", "left").withColumn("block_id", F.coalesce("__block", "block_id")).select(*assets.columns)


def safe_assets(assets: DataFrame, root: str) -> DataFrame:
    """Assets (asset_id, relative_path) that may be served: a plain id, and a path that stays below the root. Adds ``path``."""
    plain = F.col("asset_id").rlike("^[A-Za-z0-9_.-]+$")
    parts = F.split("relative_path", r"[/\\\\]")
    inside = (F.col("relative_path") != "") & ~F.col("relative_path").rlike(r"^([/\\\\]|[A-Za-z]:)") & ~F.exists(parts, lambda p: p == "..")
    return assets.where(plain & inside).withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "relative_path"))


def safe_pdfs(paths: DataFrame, root: str) -> DataFrame:
    """Adds ``problem`` to PDF paths (path): null for one that lies below the root and ends in .pdf."""
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "path"))
    outside = ~full.startswith(root.rstrip("/") + "/") | F.exists(F.split(full, "/"), lambda p: p == "..")
    problem = F.when(F.coalesce("path", F.lit("")) == "", "missing").when(outside, "outside").when(~F.lower("path").endswith(".pdf"), "not a PDF")
    return paths.withColumn("problem", problem)


def asset_id(source_hash: Column, page: Column, data: Column) -> Column:
    return F.concat(F.lit("img_"), F.substring(source_hash, 1, 12), F.lit("_p"), page.cast("string"), F.lit("_"), F.substring(F.sha2(data, 256), 1, 16))


def checked_trust(entries: DataFrame, groups: list[str]) -> DataFrame:
    """Trust entries with ``problem``: null for a valid one, else what is wrong with it."""
    status, group = F.lower(F.trim("review_status")), F.lower(F.trim("source_group"))
    year = F.col("publication_year")
    problem = (
        F.when(F.coalesce(F.trim("source_hash"), F.lit("")) == "", "missing source")
        .when(~F.coalesce(status.isin(*REVIEW_STATUSES), F.lit(False)), "unknown review status")
        .when(~F.coalesce(group.isin(*groups), F.lit(False)), "unknown source group")
        .when(year.isNotNull() & ~year.between(1000, 9999), "bad publication year")
    )
    return entries.withColumns({"review_status": status, "source_group": group, "problem": problem})


def recovered(registry: DataFrame, ledger: DataFrame, known: DataFrame) -> DataFrame:
    """Jobs of registry and ledger that are not known yet, the registry's first."""
    every = registry.select("job_id", F.lit(0).alias("rank")).unionByName(ledger.select("job_id", F.lit(1).alias("rank")))
    return every.groupBy("job_id").agg(F.min("rank").alias("rank")).join(known.select("job_id"), "job_id", "left_anti")


def missing_parts(parts: DataFrame, total: Column) -> DataFrame:
    """Of uploads in parts (upload_id, index): received count and missing indices."""
    got = parts.groupBy("upload_id").agg(F.sort_array(F.collect_set("index")).alias("have"), F.max(total).alias("total"))
    wanted = F.when(F.col("total") > 0, F.sequence(F.lit(0), F.col("total").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return got.select("upload_id", F.size("have").alias("received"), F.array_except(wanted, F.col("have").cast("array<int>")).alias("missing"))
