"""WARC and media archives: round trips, damage, and the guard around the subpackage."""

import base64
import glob
import hashlib
import random
import zlib

import pytest

from lodestone.llm import media_columns, warc_normaliser
from lodestone.llm.storage import fresh_folder


def test_warc_round_trip(spark):
    g = random.Random(1)
    rows = [(i, f"http://x.example/{i}", g.choice(["<p>same</p>", "", None, f"<p>{i}</p>" * g.randint(1, 50)])) for i in range(200)]
    rows += [(500, None, "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9), (501, "bad\nurl", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc_normaliser.warc_round_trip(pages).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, html in sorted(rows):
        raw = (html or "").encode()
        lead = first.setdefault(raw, i)
        r = got[i]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if lead == i else ("revisit", lead))
    least = {r.page_id: r.record_type for r in warc_normaliser.warc_round_trip(pages, least=20).collect()}
    assert all(least[i] == "response" for i, _, html in rows if len((html or "").encode()) < 20)


def test_warc_matches_sql(spark):
    import duckdb

    from lodestone.llm import queries

    sf = "/root/testdata/sf0.001"
    oracle = duckdb.connect()
    oracle.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = queries.QUERIES["op7_warc"](spark, sf).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(oracle.sql(queries.ORACLE_SQL["op7_warc"]).select(*names).fetchall())


def test_warc_repeated_rows_and_null_ids(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, None, "b")], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc_normaliser.warc_round_trip(pages).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "response", None), (None, "revisit", 1), (None, "response", None)], key=str)
    assert warc_normaliser.warc_round_trip(pages.where("false")).count() == 0


def test_members_stand_alone():
    records = [warc_normaliser.record_bytes(i, f"u{i}", f"body {i}".encode() * 50, None, False) for i in range(5)]
    whole = zlib.compressobj(4, zlib.DEFLATED, 31)
    import io

    data = whole.compress(b"".join(records)) + whole.flush()
    found = list(warc_normaliser.records(warc_normaliser.inflated(io.BytesIO(data))))
    assert found == records
    with pytest.raises(ValueError, match="ends within"):
        list(warc_normaliser.records(iter([records[0][:-30]])))


def test_png_round_trip():
    g = random.Random(2)
    for n in (0, 1, 63, 64, 65, 5000):
        raw = g.randbytes(n)
        payload, length = media_columns.from_png(media_columns.to_png(raw))
        assert length == n and payload == raw + bytes(len(payload) - n) and len(payload) % 64 == 0 and payload


def test_media_query_columns(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "a"), (5, "a\0"), (6, "é" * 5000), (None, "z"), (6, "é" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = media_columns.media_columns(docs).collect()
    assert len(got) == len(rows)
    for d, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = next(x for x in got if x.doc_id == d and x.n_bytes == len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (3, 4)}) == 1
    assert media_columns.media_columns(docs.where("false")).count() == 0


def test_damaged_member_is_isolated(spark):
    folder = fresh_folder(spark, "media-test")
    docs = spark.createDataFrame([(i, f"text {i} " * 30) for i in range(40)], "doc_id long, text string").coalesce(1)
    media_columns.pack_media(docs, folder)
    path = glob.glob(folder.removeprefix("file://") + "/part-*.zip")[0]
    with open(path, "r+b") as f:
        entry = media_columns.directory(__import__("pyarrow").OSFile(path))[7]
        f.seek(entry.header_offset + 60)
        f.write(b"\xff\xff\xff")
    got = media_columns.read_media(spark, folder, on_error="null", split="700").collect()
    assert len(got) == 40 and [r.id for r in got if r.error] == [7]
    with pytest.raises(Exception, match="damaged"):
        media_columns.read_media(spark, folder).count()


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_pipeline_stages(spark):
    """Each stage against plain code over its own input: nulls, empty and very long texts, ties, repeated rows."""
    import re

    import corpus_pipeline
    from lodestone.llm import packing, pii
    from lodestone.llm.queries import tokenizer_file

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    odd = [(9001, None), (9002, ""), (9003, "  "), (9004, "mail me at ann@x.example"), (9004, "mail me at ann@x.example"), (9005, "word " * 30_000), (9006, None), (None, "lost id")]
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    odd += [(9010, near), (9011, near + " again")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'src1' AS source", "cast(length(text) AS long) AS n_chars"))
    form = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.stage(stage(spark, docs, sf), f"test-{name}")
        after = docs.collect()
        assert docs.columns == columns and 0 < len(after) <= len(before)
        seen[name] = before, after
    before, after = seen["toxicity"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} <= {r.doc_id for r in before if r.text} and {9001, 9002, 9003} <= {r.doc_id for r in after}
    before, after = seen["exact_dedup"]
    groups = {}
    for r in before:
        groups.setdefault(form(r.text), []).append(r.doc_id)
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert sorted(map(str, ((r.doc_id, form(r.text)) for r in after))) == sorted(map(str, ((i, t) for t, i in first.items())))
    before, after = seen["ngram_jaccard_join"]

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {r.doc_id: grams(r.text) for r in before}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert 9011 in gone and 9010 not in gone
    for i in gone:
        assert any(j is not None and j < i and 100 * len(sets[i] & s) >= 75 * len(sets[i] | s) for j, s in sets.items() if s)
    kept = [s for i, s in sets.items() if i not in gone and s]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for k, a in enumerate(kept) for b in kept[:k])
    before, after = seen["pii"]
    texts = {r.doc_id: r.text for r in after}
    assert len(before) == len(after) and texts[9004] == "mail me at <EMAIL>" and all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    assert not any(pii.base_spans(t) for t in texts.values() if t and "<" not in t)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    e = packing.encoder(tokenizer_file("byte_bpe_50k.json"))
    assert {r.doc_id: r.doc_tokens for r in packed} == {i: len(e.encode(t or "")) + 1 for i, t in texts.items()}
    assert sum(r.length for r in packed) == sum(len(e.encode(t or "")) + 1 for t in texts.values())



def test_appends_add_and_overwrites_replace(spark):
    """Each commit has a manifest of its own; columns with names used inside and very long texts are no matter."""
    from pyspark.sql import functions as F

    folder = fresh_folder(spark, "media-appends")
    docs = lambda *ids: spark.createDataFrame([(i, f"text {i} " * (200_000 if i == 3 else 1)) for i in ids], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "payload", "media", "error")})
    media_columns.pack_media(docs(1, 2), folder)
    media_columns.pack_media(docs(3), folder)
    assert sorted(r.id for r in media_columns.read_media(spark, folder).collect()) == [1, 2, 3]
    got = {r.doc_id: r.n_bytes for r in media_columns.media_features(spark, folder).collect()}
    assert got == {i: len(f"text {i} ") * (200_000 if i == 3 else 1) for i in (1, 2, 3)}
    media_columns.pack_media(docs(4), folder, mode="overwrite")
    assert [r.id for r in media_columns.read_media(spark, folder).collect()] == [4]
    assert len(glob.glob(folder.removeprefix("file://") + "/*")) == 2  # one archive, one manifest


def test_failed_write_leaves_nothing(spark, tmp_path):
    writer = media_columns._ArchiveWriter({"path": f"file://{tmp_path}"}, False)
    import pyarrow as pa

    message = writer.write(iter([pa.record_batch([pa.array([1]), pa.array([b"a"])], names=["id", "payload"])]))
    assert glob.glob(f"{tmp_path}/*.zip")
    writer.abort([message, None])
    assert not glob.glob(f"{tmp_path}/*")


def test_ids_must_be_whole_numbers(spark):
    pages = spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string")
    docs = spark.createDataFrame([("a", "t")], "doc_id string, text string")
    with pytest.raises(TypeError, match="whole numbers"):
        warc_normaliser.warc_round_trip(pages)
    with pytest.raises(TypeError, match="whole numbers"):
        media_columns.media_columns(docs)


def test_warc_reads_the_sidecars(spark, monkeypatch):
    """Runs of members start in the middle of archives; a damaged sidecar is an error; clashing columns are no matter."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(warc_normaliser, "RUN", 7)
    pages = spark.createDataFrame([(i, "u", f"<p>{i % 50}</p>") for i in range(300)], "page_id long, url string, html string").coalesce(2)
    pages = pages.withColumns({c: F.lit("x") for c in ("name", "first", "n", "refers_to", "revisit", "__digest")})
    mono, norm = fresh_folder(spark, "mono"), fresh_folder(spark, "norm")
    archives = warc_normaliser.normalise(warc_normaliser.write_monolithic(warc_normaliser.assign_types(pages), mono), mono, norm)
    got = warc_normaliser.read_records(archives, norm).collect()
    assert sorted(r.page_id for r in got) == list(range(300)) and sum(r.record_type == "response" for r in got) == 50
    side = next(f for f in glob.glob(norm.removeprefix("file://") + "/*.idx") if len(open(f).read()) > 0)
    lines = open(side).read().splitlines()
    assert all(len(x) == warc_normaliser.LINE - 1 for x in lines)
    with open(side, "w") as f:
        f.write("\n".join(lines)[:-3])
    with pytest.raises(Exception, match="sidecar"):
        warc_normaliser.read_records(archives, norm).count()
