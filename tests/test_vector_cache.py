"""The embedding cache: what it saves, counted by calls, and its bound."""

import pandas as pd
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.sources.store import ChunkStore
from lodestone.sources.vector_cache import VectorCache


def counted(spark):
    """An embedder that counts the texts that it embeds."""
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        calls.add(len(text))
        return pd.Series([[float(len(t)), 1.0] for t in text])

    return embed, calls


def texts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, content string")


def test_a_second_run_embeds_nothing(spark, tmp_path):
    cache, (embed, calls) = VectorCache(spark, f"file://{tmp_path}/c"), counted(spark)
    some = texts(spark, ("a", "one"), ("b", "three"), ("c", "one"), ("d", None), ("e", ""))
    got = {r.id: list(r.vector) for r in cache.embedded(some, embed, "m").collect()}
    assert got == {"a": [3.0, 1.0], "b": [5.0, 1.0], "c": [3.0, 1.0], "d": [0.0, 1.0], "e": [0.0, 1.0]} and calls.value == 3
    assert {r.id: list(r.vector) for r in cache.embedded(some, embed, "m").collect()} == got and calls.value == 3
    cache.embedded(texts(spark, ("x", "one"), ("y", "new")), embed, "m").collect()
    assert calls.value == 4 and cache.size() == 4
    cache.embedded(texts(spark, ("x", "one")), embed, "m", "prefix ").collect()
    cache.embedded(texts(spark, ("x", "one")), embed, "other").collect()
    assert calls.value == 6 and cache.size() == 6


def test_the_bound_drops_what_was_used_longest_ago(spark, tmp_path):
    cache, (embed, calls) = VectorCache(spark, f"file://{tmp_path}/c", most=4), counted(spark)
    cache.embedded(texts(spark, ("1", "a"), ("2", "bb"), ("3", "ccc")), embed, "m").collect()
    cache.embedded(texts(spark, ("1", "a")), embed, "m").collect()
    cache.embedded(texts(spark, ("4", "dddd"), ("5", "eeeee")), embed, "m").collect()
    assert cache.size() == 4 and calls.value == 5
    cache.embedded(texts(spark, ("1", "a"), ("4", "dddd"), ("5", "eeeee")), embed, "m").collect()
    assert calls.value == 5  # of the first run's texts one of those not used again went
    cache.embedded(texts(spark, *[(str(i), "x" * (10 + i)) for i in range(9)]), embed, "m").collect()
    assert cache.size() == 4 and calls.value == 14


def test_the_engine_uses_it(spark, tmp_path):
    """A source that comes back under another hash costs no embedding."""
    embed, calls = counted(spark)
    trust = spark.createDataFrame([], "source_hash string, source_group string")
    engine = Engine(ChunkStore(spark, f"file://{tmp_path}/t"), trust, embed=lambda text, prefix: embed(F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))), cache=VectorCache(spark, f"file://{tmp_path}/c"))
    rows = lambda source: spark.createDataFrame([(f"r{i}", source, f"text {i}") for i in range(5)], "id string, source_hash string, content string")
    engine.index(rows("one"), dim=2)
    assert calls.value == 5
    engine.index(rows("two"), dim=2)
    assert calls.value == 5 and engine.store.count() == 10 and engine.store.read().where("size(vector) = 2").count() == 10
