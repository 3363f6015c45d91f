"""A versioned table of records in buckets of sources.

Parquet has no row-level change, so a change writes the touched buckets anew and then one small
state (``states.States``) that lists, for each bucket, the folders that hold it. Buckets that a change
does not touch stay where they are. A writer that finds another one ahead reads the newest state
and redoes its own change, so writers at the same time lose nothing.

Scale: buckets double when they hold more than ``ROWS_A_BUCKET`` rows on average, so a point edit reads and
writes about as much in a large table as in a small one; a task writes one bucket. A source is never
split, as it is replaced as a whole.

Defined cases: a table that was never written has no state, and reading it gives None; an empty
table keeps its schema; replacing a source again changes nothing; ids or sources that are not there
are an error where the docstring says so.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators import ann, retrieval
from lodestone.operators import records as rec
from lodestone.sources.states import States

BUCKETS = 16
ROWS_A_BUCKET = 200_000
MOST_BUCKETS = 1 << 16


class ChunkStore:
    """Records below ``root``, in any file system that Spark writes to. ``buckets``: how many a new table has."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 5, buckets: int = BUCKETS, rows_a_bucket: int = ROWS_A_BUCKET):
        self.spark, self.states, self.keep, self.buckets, self.rows_a_bucket = spark, States(spark, root), keep, buckets, rows_a_bucket
        self.root, self._fs = self.states.root, self.states.fs

    # --- states

    def versions(self) -> list[str]:
        """Names of the states, newest first."""
        return self.states.names()

    def current(self) -> str | None:
        return self.states.current()

    def _state(self, name: str) -> dict:
        return self.states.read(name)

    @staticmethod
    def _folders(state: dict) -> set[str]:
        return {d for dirs in state["buckets"].values() for d in dirs}

    def _change(self, make: Callable[[dict | None], dict]) -> str:
        """Commit a change of the newest state; buckets that have grown too large are doubled with it."""
        before: set[str] = set()

        def made(state: dict | None) -> dict:
            before.clear()
            before.update(self._folders(state) if state else ())
            return self._grown(make(state))

        def undone(state: dict) -> None:
            for folder in self._folders(state) - before:
                fs, p = self._fs(f"{self.root}/{folder}")
                fs.delete(p, True)

        name = self.states.change(made, undone)
        self.states.drop_old(self.keep, self._folders)
        return name

    def _grown(self, state: dict) -> dict:
        wanted = state["width"]
        while sum(state["rows"].values()) > wanted * self.rows_a_bucket and wanted < MOST_BUCKETS:
            wanted *= 2
        return state if wanted == state["width"] else self._table(self._read(state), wanted)

    def _table(self, records: DataFrame, width: int) -> dict:
        """State of a whole table written anew."""
        return {"schema": records.schema.jsonValue(), "width": width, **self._write(records, width)}

    def _read(self, state: dict, buckets: set[str] | None = None) -> DataFrame:
        dirs = [f"{self.root}/{d}" for b, found in state["buckets"].items() if buckets is None or b in buckets for d in found]
        schema = StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)

    @staticmethod
    def _bucket(width: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce("source_hash", F.lit(""))), F.lit(width)).cast("string")

    def _write(self, records: DataFrame, width: int) -> dict:
        """New folders of the buckets that the records fall into, and how many rows each has."""
        name = f"data/{uuid.uuid4().hex}"
        records.withColumn("__bucket", self._bucket(width)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{name}")
        fs, p = self._fs(f"{self.root}/{name}")
        found = [f.split("=", 1)[1] for f in (s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if f.startswith("__bucket=")]
        schema = StructType(records.schema.fields).add("__bucket", "string")
        counts = self.spark.read.schema(schema).parquet(f"{self.root}/{name}").groupBy("__bucket").count().collect() if found else []  # MOST_BUCKETS rows at most
        return {"buckets": {b: [f"{name}/__bucket={b}"] for b in found}, "rows": {r[0]: r[1] for r in counts}}

    def _touched(self, rows: DataFrame, width: int) -> set[str]:
        return {r[0] for r in rows.select(self._bucket(width).alias("b")).distinct().collect()}  # at most ``width`` rows

    def _state_or_error(self) -> dict:
        name = self.current()
        if name is None:
            raise KeyError("the table is empty")
        return self._state(name)

    # --- reading

    def exists(self, required: list[str] = ("id", "content", "source_hash")) -> bool:
        """Whether there is a table, with the columns that are needed."""
        name = self.current()
        return name is not None and set(required) <= {f["name"] for f in self._state(name)["schema"]["fields"]}

    def read(self) -> DataFrame | None:
        name = self.current()
        return self._read(self._state(name)) if name else None

    def count(self) -> int:
        table = self.read()
        return table.count() if table is not None else 0

    def size(self) -> int:
        """Bytes of the folders of the table."""
        state = self._state_or_error()
        total = 0
        for d in {d for dirs in state["buckets"].values() for d in dirs}:
            fs, p = self._fs(f"{self.root}/{d}")
            total += fs.getContentSummary(p).getLength()
        return total

    def metadata(self) -> tuple[str, int]:
        """Model and dimension of the vectors."""
        return tuple(rec.table_metadata(self._read(self._state_or_error())).first())

    def get(self, record_id: str) -> dict:
        """One record; KeyError if absent."""
        table = self.read()
        row = table.where(F.col("id") == record_id).first() if table is not None else None
        if row is None:
            raise KeyError(record_id)
        return row.asDict(recursive=True)

    def of_sources(self, hashes: list[str]) -> DataFrame:
        """Records of some sources; only their buckets are read."""
        return self.beside(self._named(hashes)).where(F.col("source_hash").isin(*hashes))

    def beside(self, rows: DataFrame) -> DataFrame:
        """Records of the buckets that the sources of some rows fall into."""
        state = self._state_or_error()
        return self._read(state, self._touched(rows, state["width"]))

    def _named(self, hashes: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(h,) for h in hashes], "source_hash string")

    def search(self, query: str, offset: int = 0, limit: int = 50) -> DataFrame:
        table = self._read(self._state_or_error())
        return rec.page(table.where(rec.matches(query)) if query.strip() else table, rec.index_order(), offset, limit)

    def batches(self, size: int = 500, search: str = "") -> Iterator[list[dict]]:
        """Rows in index order in lists of ``size``; the driver holds one partition at a time."""
        table = rec.public_rows(self._read(self._state_or_error()))
        held: list[dict] = []
        for row in (table.where(rec.matches(search)) if search.strip() else table).orderBy(*rec.index_order()).toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict(recursive=True))
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def nearest(self, queries: DataFrame, k: int = retrieval.CANDIDATES, metric: str = "l2") -> DataFrame:
        return retrieval.knn(self._read(self._state_or_error()).select("id", "vector"), queries, k, metric)

    def neighbours(self, queries: DataFrame, k: int = retrieval.CANDIDATES, least_rows: int = ann.LEAST_ROWS) -> DataFrame:
        """Nearest records by the stored index of lists, which is built once there are ``least_rows`` records and built
        anew once 1 % of them have changed; exact below that. Records of buckets that have changed since are
        searched beside it, so nothing that is gone is found and nothing new is missed."""
        state = self._state_or_error()
        rows = sum(state["rows"].values())
        if rows < least_rows:
            return self.nearest(queries, k).withColumn("score", F.round("score", 6))
        built = States(self.spark, f"{self.root}/ann")
        known = built.read(built.current()) if built.current() else None
        changed = lambda of: {b for b in {**of["buckets"], **state["buckets"]} if of["buckets"].get(b) != state["buckets"].get(b)}
        if known is None or known["width"] != state["width"] or ann.stale(sum(max(state["rows"].get(b, 0), known["rows"].get(b, 0)) for b in changed(known)), rows):
            known = {part: state[part] for part in ("buckets", "rows", "width")} | {"folder": f"ann/{uuid.uuid4().hex}"}
            named = self._read(state).select(F.concat(self._bucket(state["width"]), F.lit("|"), "id").alias("id"), "vector")
            ann.save(ann.build(named), f"{self.root}/{known['folder']}")
            built.commit(known, built.current())
            built.drop_old(1, lambda s: {s["folder"]})
        index = ann.load(self.spark, f"{self.root}/{known['folder']}")
        gone = changed(known)
        if gone:
            index = ann.Index(index.lists.where(~F.substring_index("id", "|", 1).isin(sorted(gone))), index.centroids)
        found = ann.search(index, queries, k).withColumn("id", F.expr("substring(id, instr(id, '|') + 1)"))
        if gone:
            fresh = self._read(state, gone).select("id", "vector")
            found = found.unionByName(retrieval.knn(fresh, queries, k).withColumn("score", F.round("score", 6)))
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def children(self, parent_id: str, limit: int = 80) -> DataFrame:
        """Chunks below one summary, by number."""
        table = self._read(self._state_or_error())
        below = retrieval.children(table.where(F.col("id") == parent_id), table)
        return below.orderBy("chunk_index", "child").limit(limit).join(table, F.col("child") == F.col("id")).select(*table.columns)

    # --- changing

    def publish(self, records: DataFrame) -> str:
        """The whole table anew; also the way to empty it."""
        return self._change(lambda state: self._table(records, state["width"] if state else self.buckets))

    def append(self, records: DataFrame) -> str:
        """Adds rows without reading those that are there."""

        def more(state: dict | None) -> dict:
            if state is None:
                return self._table(records, self.buckets)
            new = self._write(records.select(*[f["name"] for f in state["schema"]["fields"]]), state["width"])
            buckets = {b: state["buckets"].get(b, []) + new["buckets"].get(b, []) for b in {**state["buckets"], **new["buckets"]}}
            rows = {b: state["rows"].get(b, 0) + new["rows"].get(b, 0) for b in {**state["rows"], **new["rows"]}}
            return state | {"buckets": buckets, "rows": rows}

        return self._change(more)

    def _rewrite(self, touched: Callable[[dict], set[str]], change: Callable[[DataFrame], DataFrame], first: Callable[[], dict] | None = None) -> str:
        """Commit the touched buckets changed; the others are not read. ``first`` makes a table that is not there yet."""

        def made(state: dict | None) -> dict:
            if state is None:
                if first is None:
                    raise KeyError("the table is empty")
                return first()
            hit = touched(state)
            new = self._write(change(self._read(state, hit)), state["width"])
            kept = lambda part: {b: v for b, v in state[part].items() if b not in hit}
            return state | {part: kept(part) | new[part] for part in ("buckets", "rows")}

        return self._change(made)

    def replace_source(self, records: DataFrame) -> str:
        """The sources of the rows replaced by them; other buckets are not read."""
        return self._rewrite(lambda s: self._touched(records, s["width"]), lambda old: rec.replace_by_key(old, records), lambda: self._table(records, self.buckets))

    def delete_sources(self, hashes: list[str]) -> dict:
        """Without the records of some sources: how many went and how many are left."""
        gone = self.of_sources(hashes).count()
        if gone:
            self._rewrite(lambda s: self._touched(self._named(hashes), s["width"]), lambda old: old.where(~F.coalesce(F.col("source_hash"), F.lit("")).isin(*hashes)))
        return {"deleted": gone, "remaining": self.count()}

    def delete(self, ids: DataFrame) -> dict:
        """Without some ids: how many went and how many are left; KeyError if none is there."""
        found = lambda state: self._read(state).join(ids.select("id").distinct(), "id", "left_semi")
        gone = found(self._state_or_error()).count()
        if not gone:
            raise KeyError("none of the ids exists")
        self._rewrite(lambda s: self._touched(found(s), s["width"]), lambda old: rec.delete_ids(old, ids))
        return {"deleted": gone, "remaining": self.count()}

    def update(self, record_id: str, content: str, embed: Callable[[Column], Column], model: str, dim: int) -> str:
        """One record's content and vector changed; KeyError if absent."""
        source = self.get(record_id)["source_hash"]
        return self._rewrite(lambda s: self._touched(self._named([source]), s["width"]), lambda old: rec.changed_row(old, record_id, content, embed, model, dim))

    def reindex(self, requested: DataFrame, records: DataFrame) -> str:
        """Requested sources (source_hash) replaced by their new records, in one commit; those without any go."""
        both = requested.select("source_hash").unionByName(records.select("source_hash")).distinct()

        def changed(old: DataFrame) -> DataFrame:
            return old.join(both, "source_hash", "left_anti").unionByName(records.select(*old.columns))

        return self._rewrite(lambda s: self._touched(both, s["width"]), changed, lambda: self._table(records, self.buckets))

    # --- upkeep

    def restore(self, name: str) -> str:
        """The table as it was in a state; what it is now stays as the state before. KeyError for an unknown or unsafe name."""
        if name not in self.versions():
            raise KeyError(name)
        wanted = self._state(name)
        return self._change(lambda _: wanted)

    def compact(self) -> dict:
        """Buckets of several folders or files in one file each, the others as they are: bytes before and after."""
        before = self.size()

        def scattered(state: dict) -> set[str]:
            def files(folder: str) -> int:
                fs, p = self._fs(f"{self.root}/{folder}")
                return sum(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(p))

            return {b for b, dirs in state["buckets"].items() if len(dirs) > 1 or files(dirs[0]) > 1}

        if scattered(self._state_or_error()):
            self._rewrite(scattered, lambda old: old)
        return {"bytes_before": before, "bytes_after": self.size()}


#: Columns of the tables of the block index (fixed values).
TABLES = {
    "documents": "doc_id string, title string, source_path string, source_sha256 string, created_at string, status string, page_count int, metadata_json string",
    "pages": "doc_id string, page_num int, text string, kind string, metadata_json string",
    "blocks": "block_id string, doc_id string, page_num int, modality string, reading_order int, text string, markdown string, latex string, table_json string, bbox_json string, confidence double, asset_id string, metadata_json string",
    "assets": "asset_id string, doc_id string, block_id string, page_num int, asset_type string, path string, mime_type string, bbox_json string, metadata_json string",
    "chunks": "chunk_id string, doc_id string, text string, token_count int, section_path string, duplicate_group_id string, metadata_json string, created_at string",
    "chunk_blocks": "chunk_id string, block_id string, ordinal int",
    "chunk_vectors": "chunk_id string, vector array<float>",
}


def initialise(spark: SparkSession, database: str) -> list[str]:
    """Create the tables of the block index that are missing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return list(TABLES)


def reset(spark: SparkSession, database: str, tables: list[str] | None = None) -> None:
    """Empty the tables, or some of them."""
    for name in tables or list(TABLES):
        spark.sql(f"TRUNCATE TABLE {database}.{name}")
