"""Sums and interval labels of forests against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import records as rec
from lodestone.operators import trees


def some_forest(seed, n):
    draw = random.Random(seed)
    return {i: draw.choice([None, *range(max(0, i - draw.choice([1, 3, 40])), i)]) if i else None for i in range(n)}


def ancestors(parents, i):
    out = []
    while parents.get(i) is not None:
        i = parents[i]
        out.append(i)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_pairs_and_counts(spark, monkeypatch, seed):
    monkeypatch.setattr(trees, "HOT", 8)
    parents = some_forest(seed, 160) | {1000 + i: 5 for i in range(60)}  # a parent of many
    rows = [(p, i, "x", 1) for i, p in parents.items() if p is not None]
    edges = spark.createDataFrame(rows + rows[:9] + [(None, 3, "x", 1), (3, None, "x", 1), (7, 7, "x", 1)], "parent long, node long, top string, depth int")
    found = trees.labels(edges)
    above = {i: ancestors(parents, i) for i in parents}
    named = {i for p, i, *_ in rows} | {p for p, *_ in rows}
    got = {r.node: r for r in found.rows.collect()}
    assert set(got) == named and found.cyclic.isEmpty()
    for i in named:
        inside = {j for j in named if got[j].top == got[i].top and got[i].pre < got[j].pre <= got[i].last}
        assert inside == {j for j in named if i in above[j]} and got[i].depth == len(above[i])
    wanted = sorted((a, i, k) for i in named for k, a in enumerate(above[i], 1))
    assert sorted(map(tuple, trees.pairs(found).collect())) == wanted
    kids = {i: sum(parents[j] == i for j in named) for i in named}
    assert {r.node: (r.child_count, r.descendant_count) for r in trees.counts(found).collect()} == {i: (kids[i], sum(i in above[j] for j in named)) for i in named if kids[i]}
    assert {r.node: (r.child_count, r.descendant_count) for r in rec.node_counts(edges).collect()} == {i: (kids[i], sum(i in above[j] for j in named)) for i in named if kids[i]}


def test_cycles_and_several_parents(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (8, 9), (9, 8), (9, 10)], "parent long, node long")
    found = trees.labels(edges)
    assert {r.node: (r.pre, r["last"]) for r in found.rows.collect()} == {1: (0, 2), 2: (1, 2), 3: (2, 2)}
    assert sorted(r.node for r in found.cyclic.collect()) == [8, 9, 10]
    pairs = {(r.ancestor, r.node) for r in rec.descendants(edges).collect()}
    assert {r.node: r.descendant_count for r in rec.node_counts(edges).collect()} == {a: sum(x == a for x, _ in pairs) for a, _ in pairs}
    with pytest.raises(ValueError, match="several parents"):
        trees.labels(edges.unionByName(spark.createDataFrame([(1, 3)], "parent long, node long")))
    assert trees.labels(edges.limit(0)).rows.isEmpty()


def test_a_chain_takes_rounds_of_its_logarithm(spark, monkeypatch):
    """100,000 nodes in a chain: 17 doublings twice, each of at most a row for each node."""
    tags = []
    real = trees.stage
    monkeypatch.setattr(trees, "stage", lambda df, tag: (tags.append(tag), real(df, tag))[1])
    n = 100_000
    found = trees.labels(spark.range(1, n).select((F.col("id") - 1).alias("parent"), F.col("id").alias("node")))
    assert tags.count("tree-round") <= 2 * 18 + 2
    row = trees.counts(found).agg(F.sum("descendant_count").alias("s"), F.count(F.lit(1)).alias("n")).first()
    assert (row.s, row.n) == (n * (n - 1) // 2, n - 1)
    assert found.rows.where((F.col("depth") != F.col("node")) | (F.col("pre") != F.col("node")) | (F.col("last") != n - 1)).isEmpty()


def test_pairs_shuffle_and_blocks_have_a_largest_size(spark, monkeypatch):
    """A staged table is small as a file: no join of pairs may broadcast it, and no block takes more than its share of nodes."""
    parents = some_forest(3, 120)
    edges = spark.createDataFrame([(p, i) for i, p in parents.items() if p is not None], "parent long, node long")
    found = trees.labels(edges)
    plain = trees.pairs(found)
    assert "Broadcast" not in plain._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(trees, "LEVELS", 2)
    wanted = sorted((a, i, k) for i in parents for k, a in enumerate(ancestors(parents, i), 1))
    assert sorted(map(tuple, trees.pairs(found).collect())) == sorted(map(tuple, plain.collect())) == wanted
    blocks = spark.range(1).select(F.inline(trees._blocks(F.lit(3).cast("long"), F.lit(30).cast("long")))).collect()
    assert sorted(x for b in blocks for x in range(b["at"] << b["size"], (b["at"] + 1) << b["size"])) == list(range(3, 30)) and max(b["size"] for b in blocks) == 2
