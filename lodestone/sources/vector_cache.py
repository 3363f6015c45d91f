"""A stored cache of embeddings, by what was embedded: model, prefix and content.

A text that the cache knows is not embedded again, whatever record it stands in, in this run or any
later one; of a new text one row is embedded and written. The cache has a bound: once it holds more than
``most`` vectors, those that no run has used for longest go.

Scale: texts meet the cache by their hashes in a join; each run adds a segment of new vectors and one of uses,
and a run that finds many segments, or too many vectors, writes them as one.

Defined cases: null texts are empty; texts with equal hashes of 256 bits are equal; an embedder that
gives null leaves null and nothing is kept; two runs at the same time may both embed a text, and it is
kept once; records keep all columns but ``vector``, which is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.staging import stage
from lodestone.sources.states import States

MOST_SEGMENTS = 16


class VectorCache:
    """A cache below ``root`` of at most ``most`` vectors."""

    def __init__(self, spark: SparkSession, root: str, most: int = 100_000_000):
        self.spark, self.most, self.states = spark, most, States(spark, root)
        self.root = self.states.root

    def _state(self) -> dict:
        name = self.states.current()
        return self.states.read(name) if name else {"vectors": [], "uses": [], "run": 0, "rows": 0}

    def _read(self, state: dict, part: str, schema: str) -> DataFrame:
        folders = [f"{self.root}/{f}" for f in state[part]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def vectors(self) -> DataFrame:
        """Rows (key, vector), a key once."""
        rows = self._read(self._state(), "vectors", "key string, vector array<float>")
        return rows.groupBy("key").agg(F.first("vector").alias("vector"))

    def size(self) -> int:
        return self.vectors().count()

    @staticmethod
    def key(text: Column, model: str, prefix: str) -> Column:
        marked = f"{len(model)}:{model}{len(prefix)}:{prefix}"
        return F.sha2(F.concat(F.lit(marked), F.coalesce(text, F.lit(""))).cast("binary"), 256)

    def _written(self, rows: DataFrame, part: str) -> str:
        name = f"{part}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def embedded(self, records: DataFrame, embed: Callable[[Column], Column], model: str, prefix: str = "", text: str = "content") -> DataFrame:
        """The records with ``vector``: known texts from the cache, each new one embedded once."""
        keyed = records.drop("vector").withColumn("__key", self.key(F.col(text), model, prefix))
        asked = stage(keyed.groupBy(F.col("__key").alias("key")).agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text")), "cache-asked")
        known = self.vectors()
        fresh = asked.join(known.select("key"), "key", "left_anti").select("key", embed(F.col("text")).cast("array<float>").alias("vector"))
        fresh = stage(fresh, "cache-new").where("vector IS NOT NULL")  # embedded before the filter, which else would embed again
        hits = stage(known.join(asked.select("key"), "key", "left_semi").unionByName(fresh), "cache-hits")
        self._keep(fresh, asked.select("key"))
        return keyed.join(hits.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")

    def _keep(self, fresh: DataFrame, used: DataFrame) -> None:
        """Commit new vectors and the uses of a run, and drop what exceeds the bound."""
        added = fresh.count()
        vectors = self._written(fresh, "vectors") if added else None

        def more(state: dict | None) -> dict:
            state = state or {"vectors": [], "uses": [], "run": 0, "rows": 0}
            run = state["run"] + 1
            uses = self._written(used.select("key", F.lit(run).cast("long").alias("run")), "uses")
            out = {"vectors": state["vectors"] + ([vectors] if vectors else []), "uses": [*state["uses"], uses], "run": run, "rows": state["rows"] + added}
            return self._smaller(out) if out["rows"] > self.most or len(out["uses"]) > MOST_SEGMENTS else out

        self.states.change(more)
        self.states.drop_old(2, lambda s: {*s["vectors"], *s["uses"]})

    def _smaller(self, state: dict) -> dict:
        """One segment of vectors, of those used last as many as the bound allows, and one of their last uses."""
        last = self._read(state, "uses", "key string, run long").groupBy("key").agg(F.max("run").alias("run"))
        rows = self._read(state, "vectors", "key string, vector array<float>").groupBy("key").agg(F.first("vector").alias("vector"))
        kept = stage(rows.join(last, "key", "left").withColumn("run", F.coalesce("run", F.lit(0))), "cache-kept")
        every = kept.count()
        if every > self.most:
            # the runs from the oldest on whose vectors all go, and of the next one those of the least keys
            by_run = kept.groupBy("run").agg(F.count(F.lit(1)).alias("n")).withColumn("past", F.sum("n").over(Window.orderBy(F.desc("run"))))  # a row for each run
            edge = by_run.where(F.col("past") > self.most).orderBy(F.desc("run")).first()
            room = self.most - (edge["past"] - edge["n"])
            at = kept.where(F.col("run") == edge["run"]).orderBy("key").limit(room)
            kept = stage(kept.where(F.col("run") > edge["run"]).unionByName(at), "cache-kept")
            every = self.most
        return {"vectors": [self._written(kept.select("key", "vector"), "vectors")], "uses": [self._written(kept.select("key", "run"), "uses")], "run": state["run"], "rows": every}
