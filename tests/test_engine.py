"""The store, the composed ask, intake and jobs: against loops, with nulls, ties, clashing names and damaged inputs."""

import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import hints
from lodestone.functions import text as tx
from lodestone.functions import vectors as vec
from lodestone.operators import ann, blocks, classic, documents, intake, jobs, lifecycle, retrieval
from lodestone.operators import records as rec
from lodestone.plans import ask, queries_ask, sections
from lodestone.sources import config, files, json_files
from lodestone.sources.store import ChunkStore, initialise, reset
from lodestone.streaming import incremental

SF = "/root/testdata/sf0.001"


def recs(spark, rows):
    """Records (id, source_hash, content) in the full schema, with vectors."""
    given = spark.createDataFrame(rows, "id string, source_hash string, content string")
    return rec.conform(given.withColumn("vector", vec.embed(F.col("content"), 8)), "hash", 8)


# --- the store


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/t", buckets=16)
    assert store.read() is None and not store.exists() and store.count() == 0
    store.publish(recs(spark, [(f"{s}:{i}", f"s{s}", f"text {i} of {s}") for s in range(12) for i in range(4)]))
    before = store._state(store.current())["buckets"]
    store.replace_source(recs(spark, [("3:9", "s3", "new")]))
    after = store._state(store.current())["buckets"]
    changed = {b for b in before if before[b] != after.get(b)}
    assert len(changed) == 1 and len(before) > 3
    assert sorted(r.id for r in store.of_sources(["s3"]).collect()) == ["3:9"] and store.count() == 45
    store.replace_source(recs(spark, [("3:9", "s3", "new")]))
    assert store.count() == 45
    store.append(recs(spark, [("x:1", "s3", "more"), ("y:1", None, "no source")]))
    assert store.count() == 47 and len(store.versions()) == 4
    assert store.metadata() == ("hash", 8) and store.exists() and not store.exists(["nothing"])
    name = store.versions()[-1]
    store.restore(name)
    assert store.count() == 48 and len(store.versions()) == 5
    with pytest.raises(KeyError):
        store.restore("../x")
    for _ in range(3):
        store.append(recs(spark, [("z", "s1", "z")]))
    assert len(store.versions()) == 5 and store.count() == 51  # the oldest states and their folders are gone
    sizes = store.compact()
    assert sizes["bytes_before"] > 0 and sizes["bytes_after"] > 0 and store.count() == 51


def test_store_changes_rows(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/t", buckets=4)
    store.publish(recs(spark, [("a", "s1", "alpha"), ("b", "s1", "beta"), ("c", "s2", "gamma"), ("d", "", "delta")]))
    store.update("b", "changed", lambda t: vec.embed(t, 8), "hash", 8)
    row = store.get("b")
    assert row["content"] == "changed" and np.allclose(row["vector"], vec.hash_vector(vec.DOCUMENT_PREFIX + "changed", 8), atol=1e-6)
    with pytest.raises(KeyError):
        store.get("nobody")
    assert store.delete(spark.createDataFrame([("a",), ("nobody",)], "id string")) == {"deleted": 1, "remaining": 3}
    with pytest.raises(KeyError):
        store.delete(spark.createDataFrame([("nobody",)], "id string"))
    assert store.delete_sources(["s2", "s9"]) == {"deleted": 1, "remaining": 2}
    store.reindex(spark.createDataFrame([("s1",), ("s5",)], "source_hash string"), recs(spark, [("n", "s5", "new")]))
    assert sorted(r.id for r in store.read().collect()) == ["d", "n"]
    assert [len(b) for b in store.batches(1)] == [1, 1]
    got = list(rec.event_stream(store.read()))
    assert [e["type"] for e in got] == ["metadata", "row", "row", "done"] and got[-1] == {"type": "done", "received": 2, "total": 2} and "vector" not in got[1]["row"]
    store.publish(store.read().where("false"))
    assert store.count() == 0 and store.exists()


def test_tables_of_the_block_index(spark):
    names = initialise(spark, "lodestone_test")
    try:
        assert len(names) == 7 and initialise(spark, "lodestone_test") == names
        spark.sql("INSERT INTO lodestone_test.chunk_blocks VALUES ('c', 'b', 0)")
        reset(spark, "lodestone_test", ["chunk_blocks"])
        assert spark.table("lodestone_test.chunk_blocks").count() == 0
    finally:
        spark.sql("DROP DATABASE lodestone_test CASCADE")


def test_stream_builds_and_keeps_the_largest_row(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"source_hash": "a", "content": "one"}, {"source_hash": "a", "content": "two"}, {"source_hash": "b", "content": "three"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    store = ChunkStore(spark, f"file://{tmp_path}/t")
    stream = spark.readStream.schema("source_hash string, content string").json(f"{tmp_path}/in")
    to_records = lambda b: rec.conform(b.withColumn("id", F.col("source_hash")))
    incremental.incremental_build(stream, store, to_records, f"{tmp_path}/check").awaitTermination()
    assert sorted((r.id, r.content) for r in store.read().collect()) == [("a", "two"), ("b", "three")]


def test_held_tags_come_with_the_last_row(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("c", 0, "answer a <", False), ("c", 1, "think>deep</thi", False), ("c", 2, "nk> b <", True), ("d", 0, "x <thi", False)]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(dict(zip(("conv_id", "seq", "content", "done"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema("conv_id string, seq long, content string, done boolean").json(f"{tmp_path}/in")
    out = incremental.split_thinking(stream, done="done").writeStream.format("memory").queryName("held").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    out.awaitTermination()
    got = spark.table("held").where("conv_id = 'c'").orderBy("seq").collect()
    assert "".join(r.content for r in got if r.kind == "answer") == "answer a  b <" and "".join(r.content for r in got if r.kind == "thinking") == "deep"


# --- retrieval


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_many_queries_give_what_few_give(spark, monkeypatch, metric):
    g = np.random.default_rng(1)
    rows = [(i, g.integers(-2, 3, 4 if i % 5 else 3).astype(float).tolist()) for i in range(300)] + [(None, [1.0, 0.0, 0.0, 0.0]), (400, None)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").withColumns({c: F.lit("x") for c in ("qid", "what", "part", "score", "rank")})
    queries = spark.createDataFrame([(i, g.integers(-2, 3, 4).astype(float).tolist()) for i in range(40)] + [(99, None)], "qid long, vector array<double>")
    few = sorted(map(tuple, retrieval.knn(vectors, queries, 7, metric).collect()), key=str)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 8)
    many = sorted(map(tuple, retrieval.knn(vectors, queries, 7, metric).collect()), key=str)
    assert few == many and len(few) == 280
    asked = {r.qid: r.vector for r in queries.collect()}
    for qid in (0, 17):
        def score(v):
            n = min(len(v), 4)
            a, b = np.array(asked[qid][:n]), np.array(v[:n])
            if metric == "cosine":
                return 0.0 if not (a @ a) * (b @ b) else float(a @ b / np.sqrt((a @ a) * (b @ b)))
            return 1 / (1 + float(((a - b) ** 2).sum()))

        best = sorted(((-round(score(v), 9), i is not None, i) for i, v in rows if v is not None), key=lambda x: (x[0], x[1], x[2] or 0))[:7]
        assert [x[2] for x in best] == [r[1] for r in sorted((r for r in few if r[0] == qid), key=lambda r: r[3])]
    assert retrieval.knn(vectors.where("false"), queries).count() == 0 and retrieval.knn(vectors, queries.where("false")).count() == 0


def test_budget_fold_is_the_loop(spark):
    g = np.random.default_rng(2)
    rows = [(q, o, p, f"d{g.integers(0, 12)}", "w" * int(g.integers(0, 900)) + " " * int(g.integers(0, 5))) for q in range(4) for o in range(3) for p in range(10)]
    offered = spark.createDataFrame(rows + [(9, 0, 0, None, None)], "qid long, ordinal int, place int, id string, content string").withColumn("limit", F.lit("x"))
    got = {(r.qid, r.ordinal, r.place, r.id): (r.content, r.tokens, r.truncated) for r in retrieval.within_budget(offered, 400).collect()}
    wanted = {}
    for q in range(4):
        seen = set()
        for o in range(3):
            used = 0
            for _, _, p, i, text in sorted(r for r in rows if r[0] == q and r[1] == o):
                left = 400 - used
                if left <= 0 or i in seen:
                    continue
                cost, cut = -(-len(text) // 4) + 64, False
                if cost > left:
                    short = text[: max(0, 4 * (left - 64) - len(tx.TRUNCATION_NOTICE))].rstrip() if left >= 96 else ""
                    if not short:
                        continue
                    text, cut = short + tx.TRUNCATION_NOTICE, True
                    cost = -(-len(text) // 4) + 64
                seen.add(i)
                used += cost
                wanted[q, o, p, i] = (text, cost, cut)
    assert got.pop((9, 0, 0, None)) == ("", 64, False)
    assert got == wanted and any(w[2] for w in wanted.values())


def test_planned_asks_and_labels(spark):
    got = queries_ask.planned_asks(spark, SF).collect()
    by_q = {}
    for r in got:
        by_q.setdefault(r.qid, []).append(r)
    for rows in by_q.values():
        ids = [r.id for r in rows]
        assert len(ids) == len(set(ids))
        ordered = sorted(rows, key=lambda r: r["rank"])
        assert [(-r.score, -r.vector_score, r.id) for r in ordered] == sorted((-r.score, -r.vector_score, r.id) for r in rows)
    assert {r.ordinal for r in got} == {0, 1}
    labels = {}
    for r in queries_ask.tool_results(spark, SF).collect():
        labels.setdefault(r.qid, {})[r.chunk_id] = r.citation
    for q, rows in by_q.items():
        assert [labels[q][r.id] for r in sorted(rows, key=lambda r: r["rank"])] == [f"[S{i + 1}]" for i in range(len(rows))]


def test_records_keep_their_numbers(spark):
    records = recs(spark, [("a", "s", "one"), ("b", "s", "two")])
    ranked = spark.createDataFrame([(1, 1, "b", "two", 0.9, 0.9), (1, 2, "a", "one", 0.8, 0.8)], "qid long, rank int, id string, content string, score double, vector_score double")
    known = spark.createDataFrame([(1, 5, "a")], "conv_id long, seq int, key string")
    got = {r.chunk_id: (r.citation, r.location) for r in ask.tool_result(ranked, records, known).collect()}
    assert got == {"a": ("[S1]", "source"), "b": ("[S2]", "source")}


def test_ann_index_is_stored_and_found(spark, tmp_path):
    g = np.random.default_rng(3)
    centre = g.normal(size=(20, 8))
    rows = [(i, (centre[i % 20] + g.normal(size=8) * 0.1).tolist()) for i in range(1200)] + [(5000, None)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    folder = f"file://{tmp_path}/ann"
    assert not ann.present(spark, folder)
    ann.save(ann.build(v, 30), folder)
    index = ann.load(spark, folder)
    q = v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    found = {(r.qid, r.id) for r in ann.search(index, q, 10, probes=6).collect()}
    exact = {(r.qid, r.id) for r in retrieval.knn(v, q, 10).collect()}
    assert len(found & exact) >= 0.9 * len(exact) and ann.present(spark, folder)
    ann.drop(spark, folder)
    assert not ann.present(spark, folder)
    assert ann.stale(10, 1000) and not ann.stale(9, 1000) and not ann.stale(0, 0) and ann.wanted(50_000) and not ann.wanted(49_999)
    recall = [r.recall for r in queries_ask.ann_recall(spark, SF).collect()]
    assert sum(recall) / len(recall) >= 0.9


def test_term_scores_are_summed_where_a_chunk_lies(spark, monkeypatch):
    """No row of a question and a chunk shuffles before the choice of the best; with many terms the same is found by joins."""
    chunks = spark.createDataFrame([(i, f"common {'rare ' * (i % 3)}word{i % 5}") for i in range(40)] + [(99, None)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "common rare"), (2, "word3 word4"), (3, "")], "qid long, question string")
    found = classic.term_search(chunks, asked, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id#" in plan and not re.search(r"hashpartitioning\(qid#\w+, chunk_id#", plan)
    rows = sorted(map(tuple, found.select("qid", "chunk_id", "rank", F.round("score", 9)).collect()))
    monkeypatch.setattr(retrieval, "FEW_TERMS", 0)
    again = classic.term_search(chunks, asked, 5).select("qid", "chunk_id", "rank", F.round("score", 9))
    assert sorted(map(tuple, again.collect())) == rows and [r[0] for r in rows] == [1] * 5 + [2] * 5


def test_terms_and_modes(spark):
    chunks = spark.createDataFrame([("a", "d1", "Cooling pump pump"), ("b", "d2", "cooling fan"), ("c", "d1", None), ("d", "d3", "")], "chunk_id string, doc_id string, text string")
    asked = spark.createDataFrame([(1, "pump cooling?"), (2, "???"), (3, None)], "qid long, question string")
    got = classic.term_search(chunks, asked).collect()
    assert [(r.qid, r.chunk_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "a", 1), (1, "b", 2)]
    with pytest.raises(ValueError, match="unknown mode"):
        classic.retrieve(asked, chunks, None, "psychic")
    assert classic.term_search(chunks.where("false"), asked).count() == 0
    assert classic.store_counts({"chunks": chunks, "none": chunks.where("false")}).collect()[1].n == 0


def test_chunks_carry_headers_and_sections(spark):
    rows = [("d", 1, 1, "b1", "title", "Alpha part"), ("d", 1, 2, "b2", "text", "one two  three"), ("d", 2, 3, "b3", "section_header", "Beta"), ("d", 2, 4, "b4", "text", " "), ("e", 1, 1, "b5", "text", None)]
    b = spark.createDataFrame(rows, "doc_id string, page_num int, reading_order int, block_id string, modality string, content string")
    got = sorted(blocks.pack_blocks(b, 5).collect(), key=lambda r: r.chunk_no)
    assert [(r.block_ids, r.section, r.page_start, r.page_end, r.modalities) for r in got] == [(["b1", "b2"], "Beta", 1, 1, ["text", "title"]), (["b3"], "Beta", 2, 2, ["section_header"])]
    assert got[0].text == "Section: Beta [page 1 | title | b1] Alpha part [page 1 | text | b2] one two three"
    dup = "dup_" + hashlib.sha1(b"alpha part one two three").hexdigest()[:16]
    assert got[0].duplicate_group == dup and got[0].chunk_id == "chunk_" + hashlib.sha1("\x1f".join(["d", "b1", "b2", dup]).encode()).hexdigest()[:20]


# --- sections


def outline(spark, rows):
    return {(r.doc_id, r.ord): r for r in rows.collect()}


def test_chunks_leave_in_small_batches(spark, monkeypatch):
    """Texts of one Arrow batch give the same chunks in many batches as in one, nulls and blank texts none."""
    rows = [(i, "\n\n".join(f"part {i} {j} " + "x" * (i * 7 % 90) for j in range(i % 6))) for i in range(60)] + [(90, None), (91, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, sections.split_texts(docs, 80, 10).collect()))
    monkeypatch.setattr(sections, "TOGETHER", 100)
    assert sorted(map(tuple, sections.split_texts(docs, 80, 10).collect())) == whole
    assert {r[0] for r in whole} == {i for i in range(60) if i % 6} and all(len(r[2]) <= 80 for r in whole)


def test_outlines_by_source(spark):
    docs = spark.createDataFrame([("m", "M", "text"), ("t", "T", "text"), ("h", "H", "text"), ("v", "V", "# Seen\n\n[Vision Analysis] x"), ("n", "N", "plain"), ("z", "Z", None)], "doc_id string, doc_title string, content string")
    pages = [("m", i, f"page {i}") for i in range(1, 13)] + [("t", 1, "Contents\n1 Intro .... 3\n1.1 Scope .... 4"), ("t", 2, "x"), ("t", 3, "1 Intro\nbody"), ("t", 4, "1.1 Scope\nmore")]
    pages += [("h", 1, "# Top\n\nalpha"), ("h", 2, "## Sub\n\nbeta"), ("v", 1, "text"), ("n", 1, " "), ("n", 2, None)]
    marks = [("m", 0, 0, "Overview", 4), ("m", 1, 1, "Review", 4), ("m", 2, 1, "Changes", 6), ("m", 3, 0, "Appendix 7", 10), ("m", 4, 0, " ", 1)]
    p = spark.createDataFrame(pages, "doc_id string, page_no int, text string")
    found, own = sections.paged_outline(docs, p, spark.createDataFrame(marks, "doc_id string, ord int, level int, title string, page int"))
    got = outline(spark, found)
    assert [(got["m", i].title, got["m", i].page_start, got["m", i].page_end) for i in range(4)] == [("Overview", 4, 9), ("Review", 4, 5), ("Changes", 6, 9), ("Appendix", 10, 12)]
    assert [(got["t", i].title, got["t", i].page_start, got["t", i].page_end) for i in range(2)] == [("1 Intro", 3, 4), ("1.1 Scope", 4, 4)]
    assert [(got["h", i].title, got["h", i].level) for i in range(2)] == [("Top", 0), ("Sub", 1)]
    assert got["v", 0].title == "Seen" and got["n", 0].title == "N" and got["z", 0].title == "Z"
    records = sections.records_of(docs.select("doc_id", "doc_title"), found, own).collect()
    assert sum(r.node_type == "document_summary" for r in records) == 6
    assert any(r.node_type == "chunk" and r.title == "1.1 Scope" and r.content.endswith("1.1 Scope\nmore") for r in records)


def test_records_of_nested_and_bare_documents(spark):
    docs = [(1, "Book", "# Alpha\n\n## Bravo\n\n### Charlie\n\n#### Delta\n\ndeep text\n\n# Echo\n\nflat text"), (2, "Bare", "no heading at all\n\nsecond paragraph"), (3, "None", None), (4, "Before", "lost text\n\n# Only\n\nkept")]
    got = sections.records(spark.createDataFrame(docs, "doc_id long, title string, content string").withColumns({c: F.lit("x") for c in ("ord", "key", "t", "body")})).collect()
    by_path = {(r.node_type, r.section_path): r for r in got}
    chain = ["Alpha", "Alpha > Bravo", "Alpha > Bravo > Charlie"]
    for above, path in zip([None, *chain], chain, strict=False):
        parent = by_path["document_summary", "Book"] if above is None else by_path["section_summary", above]
        assert by_path["section_summary", path].parent_id == parent.id
    leaf = by_path["chunk", "Alpha > Bravo > Charlie > Delta"]
    assert leaf.parent_id == by_path["section_summary", chain[-1]].id and leaf.content == "Section: Alpha > Bravo > Charlie > Delta\nPages: 4\n\n#### Delta\n\ndeep text"
    assert by_path["document_summary", "Book"].content.endswith("\n\nSections:\n- Alpha\n- Bravo\n- Charlie\n- Delta\n- Echo")
    assert by_path["document_summary", "Book"].tags[:2] == ["book", "alpha"] and leaf.tags[0] == "book"
    assert [r.chunk_index for r in sorted((r for r in got if r.node_type == "chunk" and r.doc_id == leaf.doc_id), key=lambda r: r.chunk_index)] == [0, 1]
    bare = by_path["chunk", "Bare"]  # as the search for headings goes, its text begins at the first blank line
    assert bare.content == "Section: Bare\nPages: 1\n\nsecond paragraph" and by_path["section_summary", "Bare"].page_start == 1
    strict = sections.records(spark.createDataFrame(docs, "doc_id long, title string, content string"), strict=True)
    assert strict.where("node_type = 'chunk' AND title = 'Bare'").first().content.endswith("no heading at all\n\nsecond paragraph")
    assert not any(r.node_type == "chunk" and r.title in ("None",) for r in got) and not any("lost" in r.content for r in got)
    assert sections.records(spark.createDataFrame([], "doc_id long, title string, content string")).count() == 0


def test_many_headings_take_linear_time(spark):
    text = "\n\n".join(f"{'#' * (i % 6 + 1)} Heading number {i} x\n\nbody" for i in range(6000))
    docs = spark.createDataFrame([(1, "Long", text)], "doc_id long, title string, content string")
    assert sections.records(docs).where("node_type = 'chunk'").count() == 1000


# --- intake


def test_names_of_files(spark):
    rows = [("/in/a/Report.pdf",), ("/in/b/report.PDF",), ("/in/Report.pdf",), ("/in/c/Other.pdf",)]
    got = {r.path: r.output_name for r in intake.output_names(spark.createDataFrame(rows, "path string"), "/in").collect()}
    name = lambda p, stem: f"{stem}__{hashlib.blake2s(p.encode(), digest_size=6).hexdigest()}.md"
    assert got == {rows[0][0]: name("a/report.pdf", "Report"), rows[1][0]: name("b/report.pdf", "report"), rows[2][0]: "Report.md", rows[3][0]: "Other.md"}


def test_found_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for n in ("b.pdf", "x/a.PDF", "x/c.txt"):
        (tmp_path / n).write_bytes(b"1")
    assert [r.path.rsplit("/", 1)[1] for r in intake.found_pdfs(spark, str(tmp_path)).collect()] == ["b.pdf", "a.PDF"]
    assert intake.found_pdfs(spark, f"{tmp_path}/b.pdf").count() == 1
    with pytest.raises(FileNotFoundError):
        intake.found_pdfs(spark, f"{tmp_path}/nothing")
    (tmp_path / "x" / "n.md").write_text("# Head\n\npara one\n\n \n")
    got = intake.text_documents(spark, f"{tmp_path}/x").orderBy("reading_order").collect()
    assert {(r.modality, r.content) for r in got} == {("section_header", "# Head"), ("text", "para one"), ("text", "1")}


def test_bad_pages_do_not_fail_documents(spark):
    def read(content):
        if content == b"bad":
            raise ValueError("not a document")

        def page(part):
            def run():
                if part == b"!":
                    raise RuntimeError("broken page")
                return part.decode() + "  \n\n\n\nx"

            return run

        return (page(p) for p in bytes(content).split(b"|"))

    docs = spark.createDataFrame([("a", bytearray(b"one|!|two")), ("b", bytearray(b"bad"))], "path string, content binary")
    got = {(r.path, r.page_no): (r.text, r.error) for r in intake.page_texts(docs, read).collect()}
    assert got == {("a", 1): ("one\n\nx", None), ("a", 2): ("", "RuntimeError: broken page"), ("a", 3): ("two\n\nx", None), ("b", 0): ("", "ValueError: not a document")}


def test_zip_names_are_unique_across_archives(spark):
    import io
    import zipfile

    def archive(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, n)
        return bytearray(out.getvalue())

    rows = [("1.zip", archive("a.pdf", "x/A.pdf", "../e.pdf", "__MACOSX/a.pdf", "n.txt")), ("2.zip", archive("b.pdf", "y/a.pdf"))]
    got = [r.name for r in files.zip_members(spark.createDataFrame(rows, "path string, content binary")).collect()]
    assert sorted(got) == ["A_2.pdf", "a.pdf", "a_3.pdf", "b.pdf"]


def test_hints_of_known_texts(spark):
    rows = [(1, "A  B  C\n1  2  3\n4  5  6\n7  8  9"), (2, "E = m * c ^ 2"), (3, "def solve(value):\n    return value\nclass Solver:"), (4, None), (5, ""), (6, "□ = ab + c"), (7, "plain words only")]
    t = F.col("t")
    got = spark.createDataFrame(rows, "i int, t string").select("i", tx.suggests_table(t).alias("table"), hints.suggests_formula(t).alias("formula"), hints.suggests_code(t).alias("code")).collect()
    assert {r.i: (r.table, r.formula, r.code) for r in got} == {1: (True, False, False), 2: (False, True, False), 3: (False, False, True), 4: (False,) * 3, 5: (False,) * 3, 6: (False, True, False), 7: (False,) * 3}
    with pytest.raises(ValueError, match="unknown mode"):
        hints.asset_hints(t, F.lit(True), "some")


# --- jobs, settings


def test_settings(tmp_path):
    (tmp_path / "s.toml").write_text('[retrieval]\ncandidates = "many"\nmin_score = 0.7\n[index]\nkind = "odd"\nprobes = -3\n[embedding]\nhosts = ["a:1/", "a:1", "https://b"]\nodd = 1\n[other]\nx = 1\n')
    s = config.load(str(tmp_path / "s.toml"))
    assert (s.retrieval.candidates, s.retrieval.min_score, s.index.kind, s.index.probes, s.embedding.hosts) == (80, 0.7, "ivf_pq", 1, ("http://a:1", "https://b"))
    assert config.load(None) == config.Settings() == config.load(str(tmp_path / "nothing.json"))
    assert [t["function"]["name"] for t in config.search_tools(True)] == ["search_local_context", "web_search"] and len(config.search_tools(False)) == 1


def test_jobs_of_empty_tables(spark):
    none = spark.createDataFrame([], "id string, status string, phase string, error string, filenames array<string>, created_at timestamp")
    assert jobs.job_page(none, "x").count() == 0 and jobs.queue_counts(none).first().jobs == 0
    entries = spark.createDataFrame([("h", "j", "ingested", "indexed"), (None, None, None, None)], "hash string, job_id string, status string, previous string")
    events = spark.createDataFrame([("h", "j", "interrupted")], "hash string, job_id string, status string")
    assert {r.hash: r.status for r in jobs.after_event(entries, events).collect()} == {"h": "indexed", None: None}
    assert documents.recovery_jobs(entries.select("job_id", "status")).count() == 2


def test_json_files_and_overrides(spark, tmp_path):
    path = f"file://{tmp_path}/o.json"
    assert json_files.load(spark, path, {"a": 1}) == {"a": 1} and [t.count() for t in json_files.overrides(spark, path)] == [0, 0]
    for n in (1, 2):
        json_files.write(spark, path, {"edits": {"x": {"content": f"é{n}", "odd": 1}, "": {"content": "b"}, "y": 3}, "deletions": [1]})
    edits, deletions = json_files.overrides(spark, path)
    assert [(r.record_id, r.content, r.doc_id) for r in edits.collect()] == [("x", "é2", None)] and deletions.count() == 0
    edits, deletions = rec.with_deletions(edits, deletions, spark.createDataFrame([("x", "s", "d", "f", "now")], json_files.DELETION))
    json_files.write_overrides(spark, path, edits, deletions)
    assert [t.count() for t in json_files.overrides(spark, path)] == [0, 1]
    (tmp_path / "bad.json").write_text("{no")
    assert json_files.load(spark, f"file://{tmp_path}/bad.json", []) == []
    with pytest.raises(ValueError):
        json_files.load(spark, f"file://{tmp_path}/bad.json", strict=True)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["bad.json", "o.json"]


def test_images_are_stored_by_content(spark, tmp_path):
    rows = [("s1", 1, "a", bytearray(b"x")), ("s1", 1, "again", bytearray(b"x")), ("", 2, "b", bytearray(b"y")), ("s2", None, None, None)]
    images = spark.createDataFrame(rows, "source_hash string, page_no int, description string, data binary")
    entries = lifecycle.save_images(images, f"file://{tmp_path}/assets").collect()
    names = {r.asset_id for r in entries}
    assert len(entries) == 3 and names == {f"img_s1_p1_{hashlib.sha256(b'x').hexdigest()[:16]}", f"img__p2_{hashlib.sha256(b'y').hexdigest()[:16]}"}
    assert all((tmp_path / "assets" / r.relative_path).exists() for r in entries)
    assets = spark.createDataFrame([("a", None), ("b", "old"), (None, "n")], "asset_id string, block_id string")
    links = spark.createDataFrame([("a", "b1")], "asset_id string, block_id string")
    assert {(r.asset_id, r.block_id) for r in lifecycle.linked(assets, links).collect()} == {("a", "b1"), ("b", "old"), (None, "n")}


def test_engine_answers(spark, tmp_path):
    engine = Engine(ChunkStore(spark, f"file://{tmp_path}/t", buckets=4), spark.createDataFrame([("s1", "official")], "source_hash string, source_group string"), config.Settings(retrieval=config.Retrieval(min_score=0.0, relative_cutoff=0.0)))
    assert engine.metrics()["total_records"] == 0 and engine.preflight() and not engine.preflight(3)
    rows = [("a", "s1", "ridge regression uses a penalty"), ("b", "s1", "the pump cools the accumulator"), ("c", "s2", "the pump cools the accumulator")]
    engine.index(rec.conform(spark.createDataFrame(rows, "id string, source_hash string, content string")))
    engine.index(rec.conform(spark.createDataFrame([("c", "s2", "a new pump text")], "id string, source_hash string, content string")))
    asked = spark.createDataFrame([(1, "ridge regression penalty?"), (2, "zzz qqq")], "qid long, question string")
    got = engine.search(asked).where("qid = 1").orderBy("rank").collect()
    assert got[0].chunk_id == "a" and got[0].citation == "[S1]" and len(got) == 3
    assert engine.answer(asked).where("qid = 1").first().answer.startswith("[S1] ridge regression")
    m = engine.metrics()
    assert (m["total_records"], m["documents"]) == (3, 2) and m["index_bytes"] > 0


def test_json_fields_fit_their_budget():
    from lodestone.plans import context

    item = {"source": "S1", "content": 'say "x" \n' * 300}
    got, cut = context.fitted_field(item, "content", 300)
    assert cut and context.json_tokens(got) <= 300 and got["content_truncated"] and got["content"].endswith(tx.TRUNCATION_NOTICE)
    longer = {**got, "content": item["content"][: len(got["content"]) - len(tx.TRUNCATION_NOTICE) + 12].rstrip() + tx.TRUNCATION_NOTICE}
    assert context.json_tokens(longer) > 300
    assert context.fitted_field(item, "content", 95) == (None, True) and context.fitted_field({"content": "a"}, "content", 300) == ({"content": "a"}, False)
