"""The corpus pipeline: five stages, each of which reads what the one before wrote.

All but the last return the columns of ``documents``; the last returns the pieces of packed
sequences. ``run`` stages each result in the shared folder, so a lost executor costs the stage
that runs and nothing before it.

Defined cases, stage by stage: null and empty texts are never toxic; null, empty and equal texts are
copies of each other, and the row with the smallest id stays (a row with a null id only if all its
copies have none); texts without words are near copies of nothing, rows that share an id go
together and rows without one stay; a null text stays null when masked and is a document of one
closing id when packed. Repeated rows are copies. An empty table passes every stage empty. Texts of
any length are read whole; further columns of the table ride along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, ngram_join, packing, pii, toxicity
from lodestone.llm.queries import tokenizer_file
from lodestone.llm.storage import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network judges toxic go; it trains on the labelled ones among ``docs``."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar texts join the one with the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; n_chars follows."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, in the order of the curve."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
