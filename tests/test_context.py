"""Hints, lifecycle tables and context assembly on small cases."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import hints
from lodestone.operators import lifecycle
from lodestone.plans import context, sections
from lodestone.sources import files


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string")


def test_hints(spark):
    code = "def solve(value):\n    return value\nclass Solver:\n    pass"
    df = texts(spark, code, "plain words here", None, "a \\frac{1}{2} b", "x <= y + z - 1 * w")
    got = df.select("id", hints.suggests_code(F.col("t")).alias("code"), hints.suggests_formula(F.col("t")).alias("formula")).orderBy("id").collect()
    assert [r.code for r in got] == [True, False, False, False, False]
    assert [r.formula for r in got[1:]] == [False, False, True, True]
    kinds = df.select("id", hints.asset_hints(F.col("t"), F.col("id") == 1).alias("k")).orderBy("id").collect()
    assert "code" in kinds[0].k and kinds[1].k == ["picture"] and kinds[2].k == []
    with pytest.raises(ValueError, match="mode"):
        hints.asset_hints(F.col("t"), F.lit(True), "some")


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", "Y"), (3, "c", "z"), (3, "d", "z")], "k int, v string, w string")
    once = lifecycle.upsert(old, new, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "d", "z")]
    assert sorted(map(tuple, lifecycle.upsert(once, new, ["k"], ["v"]).collect())) == sorted(map(tuple, once.collect()))
    assert lifecycle.upsert(old.where("false"), new.where("false"), ["k"]).count() == 0


def test_parts_and_recovery(spark):
    parts = spark.createDataFrame([("u", 0, 4), ("u", 2, 4), ("u", 2, 4)], "upload_id string, index int, total int")
    got = lifecycle.missing_parts(parts, F.col("total")).first()
    assert (got.received, got.missing) == (2, [1, 3])
    job = lambda *x: spark.createDataFrame([(v,) for v in x], "job_id string")
    assert sorted(map(tuple, lifecycle.recovered(job("a", "b"), job("b", "c"), job("a")).collect())) == [("b", 0), ("c", 1)]


def test_shared_files_stay(spark):
    docs = spark.createDataFrame([("A", "p1"), ("A", "p2"), ("B", "p2")], "source_hash string, path string")
    gone = spark.createDataFrame([("A",)], "source_hash string")
    assert [r.path for r in lifecycle.shared_paths(docs, gone).collect()] == ["p1"]


def test_trust_problems(spark):
    rows = [("h", "Approved", "official", 2020), ("h", "approved", "friends", None), ("", "approved", "official", None), ("h", "odd", "official", None), ("h", "stale", "official", 20)]
    got = lifecycle.checked_trust(spark.createDataFrame(rows, "source_hash string, review_status string, source_group string, publication_year int"), ["official"])
    assert [r.problem for r in got.collect()] == [None, "unknown source group", "missing source", "unknown review status", "bad publication year"]


def test_assets_keep_their_first_entry(spark):
    one = spark.createDataFrame([("i1", 1, "a")], "asset_id string, created_at int, note string")
    two = spark.createDataFrame([("i1", 2, "b"), ("i2", 2, "c")], "asset_id string, created_at int, note string")
    assert sorted(r.note for r in lifecycle.add_assets(one, two).collect()) == ["a", "c"]


def test_labels_stay_with_their_records(spark):
    rows = [("c", 1, "x"), ("c", 2, "y"), ("c", 3, "x")]
    got = context.cited(spark.createDataFrame(rows, "conv_id string, seq int, key string")).orderBy("seq").collect()
    assert [r.label for r in got] == ["[S1]", "[S2]", "[S1]"]


def test_planned_queries():
    assert context.planned('["alpha?", "alpha variant"]', "alpha?", 4) == ["alpha?", "alpha variant"]
    assert context.planned('```json\n["b"]\n```', "q", 4) == ["q", "b"]
    assert context.planned('"one",\ntwo\nTWO', "q", 4) == ["q", "one", "two"]
    assert context.planned(None, "q", 4) == ["q"] and context.planned("a\nb\nc", "q", 2) == ["q", "a"]


def test_context_and_answer(spark):
    rows = [(0, 2, "[S2]", "f", "p", "second"), (0, 1, "[S1]", "f", "", "first  text")]
    df = spark.createDataFrame(rows, "qid int, place int, label string, source string, section_path string, content string")
    assert context.context_blocks(df).first().context == "[S1] f\nfirst  text\n\n[S2] f :: p\nsecond"
    assert context.extractive_answer(df).first().answer == "[S1] first text\n[S2] second"


def test_fitted_field():
    item = {"id": "a", "content": "word " * 2000}
    short, cut = context.fitted_field(item, "content", 256)
    assert cut and short["content_truncated"] and context.json_tokens(short) <= 256 < context.json_tokens(item)
    longer = {**short, "content": short["content"].replace("word word", "word word word", 1)}
    assert context.json_tokens(longer) > 254
    assert context.fitted_field(item, "content", 10) == (None, True) and context.fitted_field({"content": "x"}, "content", 256)[1] is False


def test_heading_trims(spark):
    rows = ["Cover\n1 Contents here\nx\n2 Real Start\nbody", "# Only\n\ntext", None, ""]
    t = F.col("t")
    assert [r.x for r in texts(spark, *rows).orderBy("id").select(sections.without_front_matter(t).alias("x")).collect()] == ["2 Real Start\nbody", "# Only\n\ntext", "", ""]
    cut = sections.heading_span(t, F.lit("Review"), F.lit("Changes"))
    assert [r.x for r in texts(spark, "lead\n7.1 Review\ntext\n7.2 Changes\nmore", "no heading", "", None).orderBy("id").select(cut.alias("x")).collect()] == ["7.1 Review\ntext", "no heading", "", None]
    assert texts(spark, "a  \r\n\n\n\nb").select(sections.single_blank_lines(t).alias("x")).first().x == "a\n\nb"


def test_folder_bytes(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"12345")
    assert tuple(files.folder_bytes(spark, str(tmp_path)).first()) == (1, 5)
