"""What travels: texts stay out of staged candidates and of offers that a budget can't admit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ann, retrieval
from lodestone.plans import ask, queries_ask
from lodestone.sources import staging

SF = "/root/testdata/sf0.001"


def test_candidates_travel_without_texts(spark, monkeypatch):
    staged = {}

    def seen(df, tag):
        staged.setdefault(tag, set()).update(df.columns)
        return staging.stage(df, tag)

    monkeypatch.setattr(retrieval, "stage", seen)
    monkeypatch.setattr(ask, "stage", seen)
    records, trust = queries_ask._records(spark, SF)
    assert ask.offers(records.select("id", "vector"), records, trust, queries_ask._questions(spark, SF)).count()
    assert "content" not in set().union(*staged.values())
    assert [tag for tag, columns in staged.items() if "words" in columns] == ["record-words"]  # once for each record


@pytest.mark.parametrize("several", [True, False])
def test_budget_walks_few_texts_and_gives_what_all_give(spark, monkeypatch, several):
    """Offers of which most can't be admitted, cuts that end in long white space, empty and repeated texts."""
    g = np.random.default_rng(6)
    texts = [(f"d{i}", "w" * int(g.integers(0, 2500))) for i in range(30)] + [("blank", " " * 3000), ("tail", "w" * 200 + " " * 3000), ("empty", None), ("twice", "w" * 900), ("twice", "w" * 90)]
    names = sorted({t for t, _ in texts})
    rows = [(q, o, p, names[i]) for q in range(40) for o in range(2 if several else 1) for p, i in enumerate(g.permutation(len(names))[: 3 * (q % 9)])]
    offered = spark.createDataFrame(rows, "qid long, ordinal int, place int, id string")
    offered = (offered if several else offered.drop("ordinal")).withColumn("limit", 300 + F.col("qid") * 7)
    known = spark.createDataFrame(texts, "id string, content string")
    walked, fold = [], retrieval.within_budget
    monkeypatch.setattr(retrieval, "within_budget", lambda df, budget: walked.append(df) or fold(df, budget))
    got = retrieval.admitted(offered, known, F.col("limit"))
    want = fold(offered.join(known, "id"), F.col("limit"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 40
    assert 0 < walked[0].count() < 0.5 * len(rows) and walked[1].select("qid").distinct().count() > 0


def test_a_segment_is_written_where_its_documents_lie(spark, tmp_path, monkeypatch):
    """No text and no posting shuffles, unless a task has few documents of each source."""
    from lodestone.sources.term_index import TermIndex

    plans, laid = [], TermIndex._laid_out
    monkeypatch.setattr(TermIndex, "_laid_out", lambda self, blocks: plans.append(blocks._jdf.queryExecution().executedPlan().toString()) or laid(self, blocks))
    docs = spark.range(0, 3000, 1, 3).select("id", F.concat(F.lit("s"), F.col("id") % 2).alias("source_hash"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), F.col("id") % 50)).alias("text"))
    asked = spark.createDataFrame([(1, "common w7"), (2, "w9")], "qid long, question string")
    found = []
    for name, given in (("few", docs), ("many", docs.withColumn("source_hash", (F.col("id") % 100).cast("string")))):
        index = TermIndex(spark, f"file://{tmp_path}/{name}")
        index.build(given)
        found.append(sorted((r.qid, r.id, r["rank"], round(r.score, 9)) for r in index.search(asked, 20).collect()))
    assert "Exchange" not in plans[0] and "Exchange" in plans[1] and found[0] == found[1] and len(found[0]) == 40


def test_wide_ranking_is_the_ranking_in_many_tasks(spark, monkeypatch):
    """A query with most rows is ranked by several tasks; ties and null ids go as in ``ranked``."""
    staged = []
    monkeypatch.setattr(retrieval, "stage", lambda df, tag: staged.append(staging.stage(df, tag)) or staged[-1])
    rows = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 3).alias("qid"), F.when(F.col("id") > 2, F.col("id")).alias("id"), (F.col("id") % 7 / 2.0).alias("score"))
    same = lambda df: sorted(map(tuple, df.where("id IS NOT NULL").collect()), key=str)
    got = retrieval.ranked_wide(rows, "score")
    assert same(got) == same(retrieval.ranked(rows, "score"))
    assert max(r[0] for r in staged[0].groupBy("__task").count().select("count").collect()) < 2000 < rows.where("qid IS NULL").count()


@pytest.mark.parametrize("probes", [30, 4])
def test_a_query_meets_codes_without_a_row_for_each_list(spark, monkeypatch, probes):
    """vectors without clusters, most lists probed; what leaves the tasks is bounded by shares of the codes, and the result is that of plain code."""
    made, mapped = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema, *a: made.append(mapped(self, f, schema, *a)) or made[-1])
    for name, value in (("REFINE", 2), ("QUERIES_A_TASK", 40), ("SHARES", 3), ("TOGETHER", 16), ("HELD", 500)):
        monkeypatch.setattr(ann, name, value, raising=False)
    g = np.random.default_rng(8)
    v = np.round(g.normal(size=(3000, 16)), 3).astype(np.float32)
    v[100:160] = v[100]  # equal codes: ties go by id
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector").unionByName(spark.createDataFrame([(-1, None)], "qid long, vector array<float>"))
    index = ann.build(rows, 40)
    index.lists = staging.stage(index.lists, "lists")
    table = ann.coded(index, 4)
    got = ann.search_coded(table, asked, 5, probes)
    sent = [df for df in made if df.columns == ["qid", "id", "far"]]
    assert len(sent) == 1 and sent[0].count() <= 150 * 3 * 2 * 5
    of, q, books = {r.id: r["list"] for r in index.lists.collect()}, v[::20].astype(np.float64), table.books
    codes, own = books.codes(v.astype(np.float64)), np.array([of[i] for i in range(3000)])
    want = []
    for i, x in enumerate(q):
        far = np.zeros(3000)
        for j, book in enumerate(books.books):
            far += ((x[None, j * 4 : j * 4 + 4] - book) ** 2).sum(1)[codes[:, j]]
        far[~np.isin(own, ann._nearest(q, books.centroids, probes)[i])] = np.inf
        some = np.lexsort((np.arange(3000), far))[:10]
        score = np.round(1 / (1 + ((x - v[some].astype(np.float64)) ** 2).sum(1)), 6)
        by = np.lexsort((some, -score))[:5]
        want += [(20 * i, int(some[c]), float(score[c]), r) for r, c in enumerate(by, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert ann.search_coded(table, asked.where("false"), 5, probes).count() == 0
    none = ann.build(rows.where("false"))
    assert ann.search_coded(ann.coded(none), asked, 5).count() == 0


def test_probes_are_measured_on_other_vectors_than_the_fitted(spark, monkeypatch):
    """few vectors for each centroid, so those that were fitted have their neighbours in fewer lists than others have."""
    monkeypatch.setattr(ann, "SAMPLE", 400)
    monkeypatch.setattr(ann, "MEASURED", 200)
    g = np.random.default_rng(9)
    v = np.tile(g.normal(size=(500, 32)), (12, 1)) + g.normal(scale=0.3, size=(6000, 32))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")
    asked = rows.where("id % 4 = 0").select(F.col("id").alias("qid"), "vector")
    index = ann.build(rows, 100)
    index.lists = staging.stage(index.lists, "lists")
    found = ann.search(index, asked, 10, ann.probes_for(index, asked, 10, 1, 0.9)).select("qid", "id")
    exact = retrieval.knn(rows, asked, 10).select("qid", "id")
    assert exact.join(found, ["qid", "id"]).count() >= 0.9 * exact.count()
