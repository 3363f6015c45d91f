"""Ranked lexical search against plain Python, its bounds, and its defined cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lexical_search as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    words = [(i, terms(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, w in words:
            m = 100 - 50 + (50 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in wanted if t in w)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    """Documents about some topics, of very different lengths, with copies."""
    draw = random.Random(seed)
    topics = [[f"{a}{b}" for b in range(30)] for a in ("alpha", "béta", "Gamma", "x")]
    texts = [" ".join(draw.choices(draw.choice(topics), k=draw.choice([1, 5, 40, 300]))) + draw.choice(["", " the", " The-end", " "]) for _ in range(n)]
    return list(enumerate(texts)) + [(1000 + i, texts[i % 7]) for i in range(n // 2)]


def found(spark, docs, items, k=50):
    table = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, score int, terms string").repartition(4)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    out = ls.search(ls.build(table), asked, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_code(spark, monkeypatch, seed):
    monkeypatch.setattr(ls, "SHARD_DOCS", 16)
    monkeypatch.setattr(ls, "ITEMS", 4)
    monkeypatch.setattr(ls, "SLICE_BYTES", 4000)
    docs = corpus(seed, 200) + [(None, "alpha3 alpha3"), (5, None), (6, ""), (7, " -- "), (8, "alpha1"), (8, "alpha1"), (9, "rare " * 3000)]
    items = [(i, " ".join(f"{random.Random(i).choice(['alpha', 'béta', 'GAMMA', 'x'])}{random.Random(i + j).randrange(35)}" for j in range(4)) + " the") for i in range(12)]
    items += [(20, None), (21, "??"), (22, "nowhere"), (23, "rare"), (24, "alpha1"), (24, "x2 x2"), (None, "the end")]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, items, 3) == plain(docs, items, 3)


def test_no_rows(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None), (2, "  ")], [(1, "a")]) == []
    assert found(spark, [(1, "a b")], [(1, "a")]) == plain([(1, "a b")], [(1, "a")])


def test_bounds_hold_and_shards_are_skipped(spark, monkeypatch):
    """No document scores above its shard's bound, and most shards of topical text lie below the k-th score."""
    monkeypatch.setattr(ls, "SHARD_DOCS", 32)
    docs = corpus(3, 900)
    index = ls.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    assert index.agg(F.sum("n_docs")).first()[0] == sum(bool(terms(t)) for _, t in docs)
    items = spark.createDataFrame([(1, "alpha1 alpha2 alpha3"), (2, "gamma4 gamma5 gamma6 x1")], "item_id long, text string")
    (asked,) = ls.asked_blocks(index, items, "item_id", "text")
    bounds = index.select(*ls.HEAD).mapInArrow(ls._bounded(asked, None), "item long, shard long, bound long").toPandas()
    every = index.mapInArrow(ls._scored(asked, 10**6, {s.shard: [0, 1] for s in index.select("shard").collect()}, None), "item long, doc long, score long")
    best = ls._found(index, asked, 10).groupBy("item").agg(F.min("score").alias("least")).toPandas().set_index("item").least
    of = {d: s.shard for s in index.collect() for d in ls._unpacked(s.body, (s.n_docs, np.int64), (s.n_docs, np.int64), (s.n_postings, np.uint16), (s.n_postings, np.uint32))[0].tolist()}
    limit = {(r.item, r.shard): r.bound for r in bounds.itertuples()}
    assert all(r.score <= limit[r.item, of[r.doc]] for r in every.collect())
    shards = index.count()
    visited = sum((bounds[bounds.item == i].bound >= best[i]).sum() for i in (0, 1))
    assert visited < 0.6 * 2 * shards


def test_bisection_parts_topics():
    """Two kinds of documents without a common term end on different sides of the first split."""
    doc = np.repeat(np.arange(40), 5)
    term = (np.random.default_rng(1).integers(0, 20, 200) + 20 * (doc % 2)).astype(np.int64)
    weights = ls.bisected(doc, term, 40, 40, levels=2)
    side = np.bincount(doc, weights=weights[0, term]) > 0
    assert len(set(side[::2])) == len(set(side[1::2])) == 1 and side[0] != side[1]
