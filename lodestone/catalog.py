"""The registered queries of the engine, their SQL, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import queries, queries_ask, queries_intake, queries_records, registry

QUERIES = registry.QUERIES
ORACLE_SQL = registry.ORACLE_SQL
MODULES = (queries, queries_ask, queries_intake, queries_records)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval for all questions at once."""
    return queries.hybrid_retrieve(spark, sf_dir)
