"""The engine as one object: a record store, trust entries, an embedder, and questions asked of them.

Defined cases: no question gives no rows; a question that finds nothing is answered so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vectors as vec
from lodestone.operators import records as rec
from lodestone.plans import ask, context
from lodestone.sources.config import Settings
from lodestone.sources.store import ChunkStore
from lodestone.sources.vector_cache import VectorCache


@dataclass
class Engine:
    """``embed`` makes a column of vectors from a column of texts and a prefix."""

    store: ChunkStore
    trust: DataFrame
    settings: Settings = Settings()
    embed: Callable[[Column, str], Column] = lambda text, prefix: vec.embed(text, 64, prefix)
    cache: VectorCache | None = None

    def index(self, records: DataFrame, model: str = "hash", dim: int = 64) -> str:
        """Replace the sources of some records; vectors of unchanged contents are kept, each new text is embedded once.

        Vectors come from the records of the same sources and, with a ``cache``, from any text that was embedded before.
        """
        old = self.store.beside(records) if self.store.current() else None  # the buckets of the records' sources
        known = rec.reuse_vectors(records, old if old is not None else records.sparkSession.createDataFrame([], "id string, content string, vector array<float>, embedding_model string"), model, dim)
        new, embed = known.where("NOT reused").drop("vector"), lambda t: self.embed(t, vec.DOCUMENT_PREFIX)
        fresh = self.cache.embedded(new, embed, f"{model} {dim}", vec.DOCUMENT_PREFIX) if self.cache else vec.embedded(new, embed)
        return self.store.replace_source(rec.conform(known.where("reused").unionByName(fresh), model, dim))

    def search(self, questions: DataFrame, budget: int | None = None) -> DataFrame:
        """Labelled rows for ``questions(qid, question)`` within a token budget each."""
        s = self.settings.retrieval
        records = self.store.read()
        if records is None:
            raise KeyError("the table is empty")
        asked = questions.withColumn("vector", self.embed(F.col("question"), vec.QUERY_PREFIX))
        offered = ask.offers(records.select("id", "vector"), records, self.trust, asked, s.candidates, s.lexical_weight, s.min_score, s.relative_cutoff)
        limit = budget if budget is not None else context.context_budget(F.lit(8192), F.lit(s.context_fraction), F.lit(0))
        return ask.tool_result(ask.merged(ask.retrieved(offered, records, limit), offered), records)

    def answer(self, questions: DataFrame, budget: int | None = None) -> DataFrame:
        """Extractive answers (qid, answer): the beginnings of the best rows with their labels."""
        found = self.search(questions, budget).select("qid", F.col("rank").alias("place"), F.col("citation").alias("label"), "content")
        said = context.extractive_answer(found)
        none = F.lit("I could not find relevant local source blocks for that question.")
        return questions.select("qid").join(said, "qid", "left").select("qid", F.coalesce("answer", none).alias("answer"))

    def metrics(self) -> dict:
        """Counts of records, documents and vectors, and bytes."""
        records = self.store.read()
        if records is None:
            return {"index_exists": False, "total_records": 0, "documents": 0, "embedded_records": 0, "reused_records": 0, "index_bytes": 0}
        return {"index_exists": True, **rec.manifest_totals(rec.manifest(records)).first().asDict(), "index_bytes": self.store.size()}

    def preflight(self, dim: int | None = None) -> bool:
        """Whether the embedder gives vectors of finite numbers, of a dimension if one is stated."""
        row = self.store.spark.range(1).select(self.embed(F.lit("ping"), vec.QUERY_PREFIX).alias("v")).first()
        return bool(row.v) and all(x == x and abs(x) != float("inf") for x in row.v) and dim in (None, len(row.v))
