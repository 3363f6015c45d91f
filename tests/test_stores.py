"""The record store under several writers, its growth, and the stored inverted index."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import classic
from lodestone.sources.states import Conflict, States
from lodestone.sources.store import ChunkStore
from lodestone.sources.term_index import POOL, TermIndex


def rows(spark, *pairs):
    return spark.createDataFrame([(i, s, f"text {i}") for i, s in pairs], "id string, source_hash string, content string")


def ids(store):
    return sorted(r.id for r in store.read().select("id").collect())


def test_a_second_writer_loses_nothing(spark, tmp_path):
    """While one writer replaces a source, another commits a change of another one."""
    one, two = (ChunkStore(spark, f"file://{tmp_path}/t", buckets=4) for _ in range(2))
    one.publish(rows(spark, ("a", "s1"), ("b", "s2"), ("old3", "s3"), ("old4", "s4")))
    real, calls = one._write, []

    def slow(records, width):
        if not calls:
            calls.append(1)
            two.replace_source(rows(spark, ("c", "s3")))
        return real(records, width)

    one._write = slow
    one.replace_source(rows(spark, ("d", "s4")))
    assert ids(one) == ["a", "b", "c", "d"]


def test_writers_in_threads(spark, tmp_path):
    ChunkStore(spark, f"file://{tmp_path}/t", buckets=2).publish(rows(spark, ("x", "s")))
    errors = []

    def write(k):
        try:
            ChunkStore(spark, f"file://{tmp_path}/t", keep=50).append(rows(spark, (f"n{k}", f"s{k}")))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and ids(ChunkStore(spark, f"file://{tmp_path}/t")) == ["n0", "n1", "n2", "n3", "x"]


def test_states_refuse_an_old_base(spark, tmp_path):
    states = States(spark, f"file://{tmp_path}/s")
    first = states.commit({"k": 1}, None)
    states.commit({"k": 2}, first)
    with pytest.raises(Conflict):
        states.commit({"k": 3}, first)
    assert states.read(states.current()) == {"k": 2}


def test_buckets_grow_and_compact(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/t", buckets=2, rows_a_bucket=10)
    store.publish(rows(spark, *[(f"a{i}", f"s{i % 20}") for i in range(15)]))
    assert store._state(store.current())["width"] == 2
    store.append(rows(spark, *[(f"b{i}", f"s{i % 20}") for i in range(60)]))
    state = store._state(store.current())
    assert state["width"] == 8 and store.count() == 75 and sum(state["rows"].values()) == 75
    assert sorted(r.id for r in store.of_sources(["s3"]).collect()) == ["a3", "b23", "b3", "b43"]
    store.append(rows(spark, ("c", "s3")))
    before = store._state(store.current())["buckets"]
    store.compact()
    after = store._state(store.current())["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and all(len(d) == 1 for d in after.values()) and store.count() == 76


def test_reindex_is_one_commit(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/t")
    store.publish(rows(spark, ("a", "s1"), ("b", "s2"), ("c", "s3")))
    n = len(store.versions())
    store.reindex(spark.createDataFrame([("s1",), ("s2",)], "source_hash string"), rows(spark, ("b2", "s2"), ("d", "s9")))
    assert ids(store) == ["b2", "c", "d"] and len(store.versions()) == n + 1


# --- the inverted index


def corpus(spark, n=600):
    """Documents of some sources; a few say a rare word often."""
    text = F.concat(F.repeat(F.lit("common filler words "), 3), F.when(F.col("id") % 7 == 0, F.concat(F.lit("topic"), F.col("id") % 5)).otherwise(""), F.when(F.col("id").isin(5, 300), F.repeat(F.lit(" rare"), 9)).otherwise(""))
    return spark.range(n).select("id", F.concat(F.lit("s"), (F.col("id") / 50).cast("int")).alias("source_hash"), text.alias("text"))


def asked(spark):
    return spark.createDataFrame([(1, "rare topic3"), (2, "common words"), (3, "nothing here"), (4, None), (5, "topic1")], "qid long, question string")


def searched(index, spark, k=10):
    return sorted((r.qid, r.id, r["rank"], round(r.score, 9)) for r in index.search(asked(spark), k, most=classic.MOST_TERMS).collect())


def scanned(docs, spark, k=10):
    chunks = docs.select(F.col("id").alias("chunk_id"), "text")
    return sorted((r.qid, r.chunk_id, r["rank"], round(r.score, 9)) for r in classic.term_search(chunks, asked(spark), k).collect())


def test_index_equals_the_scan_and_follows_its_sources(spark, tmp_path, monkeypatch):
    docs = corpus(spark)
    index = TermIndex(spark, f"file://{tmp_path}/i")
    with pytest.raises(KeyError):
        index.search(asked(spark), 5)
    index.build(docs)
    assert searched(index, spark) == scanned(docs, spark)
    segments = lambda: [s["name"] for s in index._state()["segments"]]
    before = segments()
    new = spark.createDataFrame([(20, "s0", "rare rare topic3"), (9001, "s0", "common")], "id long, source_hash string, text string")
    index.replace_sources(new)
    assert segments()[: len(before)] == before and len(segments()) == len(before) + 1
    written = spark.read.parquet(f"file://{tmp_path}/i/{segments()[-1]}")
    assert [r.source for r in written.select("source").distinct().collect()] == ["s0"]
    changed = docs.where("source_hash <> 's0'").unionByName(new)
    assert searched(index, spark) == scanned(changed, spark)
    index.delete_sources(["s6"])
    changed = changed.where("source_hash <> 's6'")
    assert searched(index, spark) == scanned(changed, spark)
    again = docs.where("source_hash = 's6'")
    index.append(again)
    assert searched(index, spark) == scanned(changed.unionByName(again), spark)
    index.compact()
    assert len(segments()) == 1 and searched(index, spark) == scanned(changed.unionByName(again), spark)


def test_search_reads_no_text_and_skips_runs(spark, tmp_path):
    index = TermIndex(spark, f"file://{tmp_path}/i")
    index.build(corpus(spark, 6000).repartition(4))
    pairs, opened = index.coverage(spark.createDataFrame([(1, "rare common")], "qid long, question string"), 2)
    assert opened < pairs / 2, (pairs, opened)
    plan = index.search(asked(spark), 3)._jdf.queryExecution().toString()
    assert "regexp_extract_all(text" not in plan and "text#" not in plan


def test_index_of_keywords_equals_pool_scores(spark, tmp_path):
    from lodestone.operators import retrieval

    docs = corpus(spark)
    index = TermIndex(spark, f"file://{tmp_path}/k", tx.keywords)
    index.build(docs)
    whole = {(r.qid, r.id): round(r.bm25, 9) for r in retrieval.bm25(docs, F.col("text"), asked(spark)).collect()}
    stored = {(r.qid, r.id): round(r.bm25, 9) for r in retrieval.bm25_of(index.matches(asked(spark))).collect()}
    assert whole == stored
    best = {(r.qid, r.id): round(r.score, 9) for r in index.search(asked(spark), 5, POOL).collect()}
    assert best.items() <= whole.items() and len(best) == 15


def test_awkward_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "rare"), (2, "s", None), (3, "s", ""), (4, None, "x")], "id long, source_hash string, text string")
    index = TermIndex(spark, f"file://{tmp_path}/i")
    index.build(docs)
    assert searched(index, spark) == scanned(docs, spark)
    index.build(docs.limit(0))
    assert searched(index, spark) == []
