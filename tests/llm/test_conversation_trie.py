"""The conversation trie against plain Python over lists, and its defined cases."""

import hashlib
import math
import random
import zlib

import pytest

from lodestone.llm import conversation_trie as ct

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {n: sum(len(x) == len(n) + 1 and x[: len(n)] == n for x in nodes) for n in nodes}
    out = []
    for n, members in nodes.items():
        below = [x for x in nodes if x[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(n))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children[n], sum(children[x] == 0 for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    table = spark.createDataFrame([(c, t, r, x, "clash", 1) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    out = ct.trie(table)
    assert out.columns == NAMES
    return sorted((tuple(r) for r in out.collect()), key=str)


def some_rows(seed, convs, words=3):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant"]), draw.choice("aébc"[:words]) * draw.randrange(3)) for c in range(0, convs * 7, 7) for t in range(draw.randrange(1, 9))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_code(spark, seed):
    rows = some_rows(seed, 90)
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(5)]  # copies, at one node
    rows += [(None, 0, "user", "x"), (3, None, None, None), (3, None, "user", "é"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (-5, 0, "user", "a"), (201, 0, "user", "only")]
    random.Random(seed).shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_long_conversations_and_many_ends(spark, monkeypatch):
    """Chunks, pieces and runs of a few rows, so that every boundary is crossed."""
    monkeypatch.setattr(ct, "CHUNK", 4)
    monkeypatch.setattr(ct, "PIECE_IDS", 3)
    rows = [(500, t, "user", "abc"[t % 3]) for t in range(60)] + [(501, 0, "user", "again")] * 40
    rows += [(c, t, "user", "same") for c in range(600, 700) for t in range(6)]
    assert found(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []
    one = found(spark, [(c, 0, "user", "x") for c in (1, 2)])
    assert one == plain([(c, 0, "user", "x") for c in (1, 2)])


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    tags = []
    real = ct.stage
    monkeypatch.setattr(ct, "stage", lambda df, tag, *a: (tags.append(tag), real(df, tag, *a))[1])
    chain = spark.range(1, 201).selectExpr("id AS node", "nullif(id - 1, 0) AS parent", "1L AS v")
    got = {r.node: r.v for r in ct.subtree_sums(chain, ["v"]).collect()}
    assert got == {i: 201 - i for i in range(1, 201)} and tags.count("trie-round") == 9
