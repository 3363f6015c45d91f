"""Operators on small cases with known results, and on empty and null input."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vec
from lodestone.operators import ann, blocks, documents, records, retrieval
from lodestone.plans import sections
from lodestone.sources import files
from lodestone.sources.store import ChunkStore
from lodestone.streaming import incremental


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


def test_gate_and_reliability(spark):
    pool = [(0, "a", 1.0, "alpha", "official"), (0, "b", 0.75, "", "official"), (0, "c", 0.71, "", "official")]
    asked = spark.createDataFrame([(0, "zzzz?")], "qid int, question string")
    schema = "qid int, id string, score double, content string, source_group string"
    assert [r.id for r in retrieval.hybrid(spark.createDataFrame(pool, schema), asked).orderBy("rank").collect()] == ["a", "b"]
    pool = [(0, "u", 0.92, "same", "unofficial"), (0, "o", 0.88, "same", "official")]
    got = retrieval.hybrid(spark.createDataFrame(pool, schema), asked).orderBy("rank").collect()
    assert [r.id for r in got] == ["o", "u"] and got[1].hybrid_score > got[0].hybrid_score


def test_lexical_rerank(spark):
    pool = [(0, "v", 0.95, "generic optimization background", "official"), (0, "l", 0.90, "Ridge regularization", "official")]
    asked = spark.createDataFrame([(0, "ridge regularization lambda")], "qid int, question string")
    got = retrieval.hybrid(spark.createDataFrame(pool, "qid int, id string, score double, content string, source_group string"), asked).orderBy("rank").collect()
    assert got[0].id == "l" and got[0].vector_score == 0.9


def test_bm25_prefers_rare_words(spark):
    docs = spark.createDataFrame([("r1", "rareword appears here only once in the pool"), ("r2", "commonword is in every document here"), ("r3", "commonword also here and here")], "id string, text string")
    got = {r.id: r.bm25 for r in retrieval.bm25(docs, F.col("text"), spark.createDataFrame([(0, "rareword commonword")], "qid int, question string")).collect()}
    assert got["r1"] > got["r2"] and got["r1"] > got["r3"]
    assert retrieval.bm25(docs.where("false"), F.col("text"), spark.createDataFrame([(0, "x")], "qid int, question string")).count() == 0


def test_rank_fusion(spark):
    a = spark.createDataFrame([(0, x, i + 1) for i, x in enumerate("abc")], "qid int, id string, rank int")
    b = spark.createDataFrame([(0, x, i + 1) for i, x in enumerate("bad")], "qid int, id string, rank int")
    got = {r.id: r.rrf for r in retrieval.fuse([a, b]).collect()}
    assert got["a"] == pytest.approx(got["b"]) and got["a"] > got["c"] and got["a"] > got["d"]


def test_budget(spark):
    schema = "qid int, id string, place int, content string"
    assert [r.id for r in retrieval.within_budget(spark.createDataFrame([(0, "a", 1, "alpha " * 220), (0, "b", 2, "beta " * 220)], schema), 256).collect()][:1] == ["a"]
    got = retrieval.within_budget(spark.createDataFrame([(0, "a", 1, "alpha " * 2000)], schema), 256).collect()
    assert len(got) == 1 and got[0].truncated and got[0].tokens <= 256 and got[0].content.endswith(tx.TRUNCATION_NOTICE)


def test_summary_expansion(spark):
    rows = [("d", "d", "", "document_summary", -1), ("c1", "d", "d", "chunk", 0), ("c2", "d", "d", "chunk", 1), ("x", "e", "", "chunk", 0)]
    every = spark.createDataFrame(rows, "id string, doc_id string, parent_id string, node_type string, chunk_index long")
    top = spark.createDataFrame([(0, "d", 1, 0.9), (0, "x", 2, 0.8), (0, "c2", 3, 0.7)], "qid int, id string, rank int, vector_score double")
    got = retrieval.expand_summaries(top, every).orderBy("place").collect()
    assert [(r.id, r.vector_score) for r in got] == [("c1", 0.9), ("c2", 0.9), ("x", 0.8)]


def test_knn_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    v = np.random.default_rng(1).standard_normal((300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")
    queries = df.where("id < 7").select(F.col("id").alias("qid"), "vector")
    got = retrieval.knn(df.unionByName(df.where("false")), queries, 5).collect()
    for q in range(7):
        wanted = np.argsort(((v - v[q]) ** 2).sum(1), kind="stable")[:5]
        assert [r.id for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == wanted.tolist()
    assert retrieval.knn(df, queries.where("false")).count() == 0


def test_ann_recall(spark):
    g = np.random.default_rng(2)
    v = (g.standard_normal((20, 8)) * 4)[g.integers(0, 20, 2000)] + g.standard_normal((2000, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")
    queries = df.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    index = ann.build(df)
    assert index.lists.count() == 2000
    found = {(r.qid, r.id) for r in ann.search(index, queries, 10, probes=12).collect()}
    exact = {(r.qid, r.id) for r in retrieval.knn(df, queries, 10).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_ann_recall_with_many_lists(spark):
    v = np.random.default_rng(4).standard_normal((3000, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")
    queries = df.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    index = ann.build(df, lists=600)
    assert ann.PROBES < ann.probes_for(index, queries, 10) < 600
    found = {(r.qid, r.id) for r in ann.search(index, queries, 10).collect()}
    exact = {(r.qid, r.id) for r in retrieval.knn(df, queries, 10).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    assert ann.search(index, queries.where("false"), 10).count() == 0


def test_ann_search_by_parts_is_the_plain_one(spark, monkeypatch):
    """Lists of several parts and parts of several lists give what a loop over the probed lists gives, copies by id."""
    monkeypatch.setattr(ann, "PART_ROWS", 60)
    monkeypatch.setattr(ann, "TOGETHER", 7)
    v = np.random.default_rng(6).standard_normal((900, 6)).astype(np.float32)
    v[:200] = v[0]  # copies, more than a part holds
    df = spark.createDataFrame([(f"v{i:03}", x.tolist()) for i, x in enumerate(v)] + [("none", None)], "id string, vector array<float>")
    queries = df.where("id LIKE 'v%0' OR id = 'none'").select(F.col("id").alias("qid"), "vector")
    index = ann.build(df, 20)
    own = {r.id: r["list"] for r in index.lists.collect()}
    found = {}
    for r in ann.search(index, queries, 12, probes=5).orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append((r.id, r.score))
    assert len(found) == 90
    for qid, rows in found.items():
        q = v[int(qid[1:])].astype(float)
        lists = ann._nearest(q[None], index.centroids, 5)[0]
        each = [(-round(1 / (1 + float(((q - x.astype(float)) ** 2).sum())), 6), f"v{i:03}") for i, x in enumerate(v) if own[f"v{i:03}"] in lists]
        assert rows == [(i, -s) for s, i in sorted(each)[:12]]


def test_bounded_sample_is_the_one_of_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 50)
    rows = spark.range(5000).select("id", F.array(F.col("id").cast("double")).alias("vector"))
    wanted = [r[0] for r in rows.orderBy(F.xxhash64("id")).limit(50).select("vector").collect()]
    assert ann.sample_of(rows, ["id"], 5000) == wanted == ann.sample_of(rows, ["id"], 100)
    same = rows.select(F.lit(7).alias("id"), "vector")
    assert len(ann.sample_of(same, ["id"], 5000)) == 50


def test_vectors(spark):
    pair = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [3.0, 4.0, 9.0])], "a array<float>, z array<float>, w array<float>")
    row = pair.select(vec.cosine(F.col("a"), F.col("z")).alias("zero"), vec.cosine(F.col("a"), F.col("w")).alias("same"), vec.normalised(F.col("z")).alias("n"), vec.fit_dimension(F.col("a"), 3).alias("f")).first()
    assert row.zero == 0 and row.same == pytest.approx(1) and row.n == [0, 0] and row.f == [3, 4, 0]
    assert np.linalg.norm(vec.hash_vector("search_query: some words", 64)) == pytest.approx(1) and not vec.hash_vector("", 8).any()


def test_overrides_reuse_and_replace(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, content string")
    edits, gone = spark.createDataFrame([("a", "new")], "id string, content string"), spark.createDataFrame([("b",)], "id string")
    assert sorted(map(tuple, records.apply_overrides(rows, edits, gone).select("id", "content", "edited").collect())) == [("a", "new", True), ("c", "3", False)]
    old = rows.withColumns({"vector": F.array(F.lit(1.0), F.lit(2.0)), "embedding_model": F.lit("m")})
    changed = rows.withColumn("content", F.when(F.col("id") == "a", "x").otherwise(F.col("content")))
    assert {r.id: r.reused for r in records.reuse_vectors(changed, old, "m", 2).collect()} == {"a": False, "b": True, "c": True}
    table = rows.withColumn("source_hash", F.when(F.col("id") == "a", "A").otherwise("B"))
    new = spark.createDataFrame([("z", "9", "A")], "id string, content string, source_hash string")
    once = records.replace_by_key(table, new)
    assert sorted(r.id for r in once.collect()) == ["b", "c", "z"] == sorted(r.id for r in records.replace_by_key(once, new).collect())


def test_conform_and_search(spark):
    got = records.conform(spark.createDataFrame([("a", "100% _sure", [1.0])], "id string, content string, vector array<float>"), "m", 3).first()
    assert (got.chunk_index, got.page_start, got.tags, got.vector, got.embedding_dim, got.node_type) == (-1, 0, [], [1, 0, 0], 3, "chunk")
    rows = records.conform(spark.createDataFrame([("a", "100% _sure"), ("b", "100 sure")], "id string, content string"))
    assert [r.id for r in rows.where(records.matches("0% _S")).collect()] == ["a"]


def test_tree_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, node string")
    got = {(r.ancestor, r.node) for r in records.descendants(edges).collect()}
    assert ("a", "d") in got and ("d", "a") not in got and ("a", "a") not in got


def test_deep_tree(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)], "parent long, node long")
    got = {(r.ancestor, r.node, r.depth) for r in records.descendants(edges).collect()}
    assert got == {(a, b, b - a) for a in range(71) for b in range(a + 1, 71)}
    assert {r.node: r.descendant_count for r in records.node_counts(edges).collect()} == {i: 70 - i for i in range(70)}


def test_manifest(spark):
    rows = records.conform(spark.createDataFrame([("1", "chunk", "abc", "h", 1, 2), ("2", "section_summary", "d", "h", 0, 3), ("3", "chunk", "", "", 0, 0)], "id string, node_type string, content string, source_hash string, page_start int, page_end int"))
    got = {r.source_key: r for r in records.manifest(rows).collect()}
    assert (got["h"].record_count, got["h"].chunk_count, got["h"].summary_count, got["h"].page_start, got["h"].page_end) == (2, 1, 1, 1, 3) and "unknown" in got


def test_three_equal_blocks_make_one_duplicate_group(spark):
    rows = [("d", 1, i, f"b{i}", "text", "one two three four five six seven eight") for i in range(3)]
    got = blocks.pack_blocks(spark.createDataFrame(rows, "doc_id string, page_num int, reading_order int, block_id string, modality string, content string"), 8, 0).collect()
    assert len(got) == 3 and len({r.duplicate_group for r in got}) == 1


def test_band_join(spark):
    b = spark.createDataFrame([(f"b{i}", "d", 1, i) for i in range(6)] + [("o", "d", 2, 3)], "block_id string, doc_id string, page_num int, reading_order int")
    got = blocks.neighbours(b, b.where("block_id = 'b3'"), 1).collect()
    assert sorted(r.block_id for r in got) == ["b2", "b3", "b4"]


def test_text_functions(spark):
    assert one(spark, tx.snippet(F.lit("a  b\n" + "x" * 400), 20)) == "a b " + "x" * 15 + "..."
    assert one(spark, tx.page_range(F.lit(None).cast("long"), F.lit(None).cast("long"))) == "unknown"
    assert one(spark, tx.is_usable_text(F.lit("Enough extracted text"), 10)) and not one(spark, tx.is_usable_text(F.lit("   \n")))
    assert one(spark, tx.suggests_table(F.lit("A  B  C\n1  2  3\n4  5  6\n7  8  9"))) and one(spark, tx.suggests_equation(F.lit("E = m * c ^ 2")))
    assert one(spark, tx.unwrapped_url(F.lit("//s.example/l/?uddg=https%3A%2F%2Fexample.com%2Fpaper&x=1"))) == "https://example.com/paper"
    assert one(spark, tx.normalized_heading(F.lit("7.2 Changes at  Test time 206"))) == "changesattesttime"
    assert one(spark, tx.normalize_page(F.lit("Head\r\n12\nbody\nHead\nmore\nHead"))) == "body\nHead\nmore\nHead"
    assert one(spark, tx.fitted(F.lit("word " * 1000), F.lit(200))).endswith(tx.TRUNCATION_NOTICE)
    assert one(spark, tx.safe_component(F.lit("../a b?.pdf"), "x")) == "a-b-.pdf" and one(spark, tx.safe_component(F.lit(None).cast("string"), "x")) == "x"


def test_sizes_round_ties_to_even(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 2304, 2305, 60113, 1024**2 * 5 // 4, 1024**3 * 9 // 4]
    shown = spark.createDataFrame([(n,) for n in sizes], "n long").select(tx.human_bytes(F.col("n"))).collect()
    wanted = ["0 B", "1023 B", *(f"{n / 1024:.1f} KB" for n in sizes[2:8]), "1.2 MB", "2.2 GB"]
    assert [r[0] for r in shown] == wanted


def test_claims(spark):
    answers = spark.createDataFrame([("a", "The report discusses spring stiffness and damping ratios [S1]. Aerodynamic vortices define accumulator voltage limits [S1].")], "answer_id string, text string")
    source = spark.createDataFrame([("a", "[S1]", "The suspension report discusses spring stiffness and damping ratios.")], "answer_id string, label string, content string")
    got = documents.weak_claims(answers, source).collect()
    assert len(got) == 1 and got[0].labels == ["[S1]"] and got[0].fragment_no == 1


def test_sections(spark):
    toc = sections.toc_entries(spark.createDataFrame([("d", "7.2 Changes at test time . . . . . . . . . 206")], "doc_id string, text string")).first()
    assert (toc.number, toc.title, toc.page) == ("7.2", "Changes at test time", 206)
    assert sections.split_texts(spark.createDataFrame([("d", "alpha " * 500), ("e", None)], "doc_id string, text string"), 200, 20).count() > 1
    docs = spark.createDataFrame([("k", "Book", "# Overview\n\nalpha\n\n## Details\n\nbeta"), ("e", "Empty", None)], "doc_id string, title string, content string")
    got = sections.records(docs).collect()
    chunks = [r for r in got if r.node_type == "chunk"]
    assert [r.section_path for r in chunks] == ["Overview > Details"] and "beta" in chunks[0].content and not any("alpha" in r.content for r in chunks)
    tree = {r["ord"]: r for r in sections.section_tree(sections.headings(docs)).collect()}
    assert tree[1].parent_ord == 0 and tree[0].parent_ord == -1 and tree[0].next_ord is None


def test_page_ends(spark):
    rows = [("d", 0, 0, "a", 4), ("d", 1, 1, "b", 4), ("d", 2, 1, "c", 6), ("d", 3, 0, "e", 10)]
    tree = sections.section_tree(spark.createDataFrame(rows, "doc_id string, ord int, level int, title string, page_start int"))
    got = sections.with_page_ends(tree, F.lit(12)).orderBy("ord").collect()
    assert [r.page_end for r in got] == [9, 5, 9, 12] and [r.next_title for r in got] == [""] * 4


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\ntext")
    (tmp_path / "b.txt").write_text("no")
    got = files.markdown(spark, str(tmp_path)).collect()
    assert [r.title for r in got] == ["a"] and got[0].content == "# Title\n\ntext"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name in ("x/one.pdf", "../bad.pdf", "two.PDF", "__MACOSX/three.pdf", "note.txt"):
            z.writestr(name, b"%PDF")
    archives = files.binaries(spark, str(tmp_path), "*.zip")
    assert sorted(r.name for r in files.zip_members(archives).collect()) == ["one.pdf", "two.PDF"]
    html = '<a class="result-link" href="//s.example/l/?uddg=https%3A%2F%2Fexample.com%2Fpaper">Paper</a><td class="result-snippet">Useful <b>snippet</b></td>'
    got = files.search_results(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"), 5).collect()
    assert [(r.title, r.url, r.snippet) for r in got] == [("Paper", "https://example.com/paper", "Useful snippet")]
    bad = spark.createDataFrame([("d", '{"version": 2, "pages": ["x"]}'), ("e", "no json"), ("f", None)], "doc_id string, sidecar string")
    assert files.from_sidecar(bad).count() == 0


def test_store(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store", keep=3)
    rows = lambda *x: records.conform(spark.createDataFrame([(i, c, s) for i, c, s in x], "id string, content string, source_hash string"))
    assert store.read() is None
    store.replace_source(rows(("a", "alpha", "A"), ("b", "beta", "B")))
    first = store.current()
    store.replace_source(rows(("c", "new", "A")))
    store.replace_source(rows(("c", "new", "A")))
    assert sorted(r.id for r in store.read().collect()) == ["b", "c"] and store.get("b")["content"] == "beta"
    with pytest.raises(KeyError):
        store.get("a")
    assert store.search("BETA").first().total == 1
    store.restore(first)
    assert sorted(r.id for r in store.read().collect()) == ["a", "b"]
    store.delete(spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in store.read().collect()] == ["b"] and len(store.versions()) == 3


def test_incremental_build(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    inbox = tmp_path / "inbox"
    schema = "source_hash string, content string"
    to_records = lambda b: records.conform(b.withColumn("id", F.concat("source_hash", F.lit(":0"))))
    for batch in ([("A", "one"), ("B", "two")], [("A", "three")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(inbox))
        stream = spark.readStream.schema(schema).json(str(inbox))
        incremental.incremental_build(stream, store, to_records, str(tmp_path / "state")).awaitTermination()
    assert {r.source_hash: r.content for r in store.read().collect()} == {"A": "three", "B": "two"}


def test_thinking_split():
    out, inside, held = incremental.think_parts("a<thi", False)
    assert (out, inside, held) == ([("answer", "a")], False, "<thi")
    out, inside, held = incremental.think_parts(held + "nk>b</think>c", inside)
    assert (out, inside, held) == ([("thinking", "b"), ("answer", "c")], False, "")


def test_progress_lines(spark):
    lines = spark.createDataFrame([('__RAG_PROGRESS__ {"phase": "embed", "done": 3, "unit": "rows"}',), ("__RAG_PROGRESS__ {bad",), ("text",)], "value string")
    got = incremental.progress_events(lines).collect()
    assert [(r.phase, r.done, r.total) for r in got] == [("embed", 3, None)]
