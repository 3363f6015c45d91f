"""Exact, substring, line and near-duplicate operators against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from lodestone.llm import exact_dedup, line_dedup, ngram_join, packed, queries, substring_dedup
from lodestone.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(900, None), (901, ""), (902, "  \n\t"), (903, "one"), (903, "one"), (None, "lost id"), (904, "One"), (905, "x" * 3000 + " " + "y " * 40), (906, "z" * 700 + " " + " ".join(f"long{i % 5000}" for i in range(12_000)))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def awkward(docs):
    """Columns whose names clash with those used inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({"key": F.lit("k"), "score": F.lit(1), "__row": F.lit("r"), "n": F.lit(2), "data": F.lit("d")})


def passages(seed=1, docs=80):
    g = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(docs):
        k = g.random()
        if k < 0.2:
            words = ["a"] * g.randint(0, 60)
        elif k < 0.4:
            words = ["x", "y"] * g.randint(0, 30)
        else:
            at = g.randint(0, 150)
            words = [f"p{d}_{i}" for i in range(g.randint(0, 12))] + base[at : at + g.randint(5, 50)] + [f"q{d}_{i}" for i in range(g.randint(0, 12))]
        rows.append((d, " ".join(words)))
    return rows + rows[:6] + EDGES


def brute_substrings(rows, window):
    count = collections.Counter()
    for _, t in rows:
        w = WORD.findall(t or "")
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [3, 8, 35])
def test_substrings_match_brute_force(spark, window):
    rows = passages()
    got = substring_dedup.remove_repeats(awkward(frame(spark, rows)), window).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings(rows, window)


def test_substrings_in_chunks_and_small_flushes(spark, monkeypatch):
    """Long texts are parsed in overlapping pieces; a task may send its groups in several parts."""
    rows = passages(2, 30)
    h = np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint64)
    whole = substring_dedup.groups(h, np.array([0, 3000]), 35)
    monkeypatch.setattr(substring_dedup, "_CHUNK", 300)
    found = []
    for a, z, row in substring_dedup.chunks(np.array([0, 3000]), 35):
        sym, every, at, n = substring_dedup.groups(h[a:z], row, 35)
        found += [(int(a + s + i), int(x)) for s, m, x in zip(at, n, sym, strict=True) for i in range(m)]
    assert found == [(int(s + i), int(x)) for s, m, x in zip(whole[2], whole[3], whole[0], strict=True) for i in range(m)]
    got = substring_dedup.remove_repeats(frame(spark, rows), 8).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings(rows, 8)


def brute_exact(rows):
    form = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[form(t)].append(d)
    return {(d, hashlib.sha256(form(t).encode()).hexdigest()): (min((x for x in groups[form(t)] if x is not None), default=None), len(groups[form(t)])) for d, t in rows}


def test_exact_copies(spark):
    g = random.Random(4)
    rows = [(i, g.choice(["same  text", "same text", "other", f"own {i}"])) for i in range(300)] + EDGES
    got = exact_dedup.decisions(awkward(frame(spark, rows))).collect()
    assert {(r.doc_id, bytes(r.text_sha256).hex()): (r.keep_id, r.group_size) for r in got} == brute_exact(rows)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows})
    kept = exact_dedup.exact_dedup(awkward(frame(spark, rows)))
    assert kept.columns == awkward(frame(spark, rows)).columns and kept.count() == sum(r.kept for r in got)


def test_filter_has_no_false_negatives(spark):
    """Every repeated digest is tested as possibly repeated, also in a filter that is far too small."""
    from pyspark.sql import functions as F

    digests = spark.range(3000).select(F.unhex(F.sha2((F.col("id") % 2000).cast("string"), 256)).alias("__digest"))
    plane, words = exact_dedup.repeated_plane(digests, 10)
    tested = exact_dedup.with_maybe(digests.distinct(), plane, words)
    assert tested.where("__maybe").count() >= 1000


def brute_lines(rows, run):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, out = {}, []
    for i in order:
        d, t = rows[i]
        lines = t.split("\n") if t else []
        counted = [j for j, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for k in range(len(counted) - run + 1):
            key = tuple(lines[j] for j in counted[k : k + run])
            if first.setdefault(key, (i, k)) != (i, k):
                gone.update(counted[k : k + run])
        kept = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        out.append((d, len(counted), len(gone), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("run", [1, 3, 4])
def test_lines_match_brute_force(spark, run):
    g = random.Random(run)
    rows = [(i, "\n".join(g.choice(["common", f"l{g.randint(0, 9)}", "", f"own {i} {k}"]) for k in range(g.randint(0, 14)))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, " \n\t\n"), (None, "common\nl1\nl2\nl3\nl4"), (903, "\n".join(f"l{i % 10}" if i % 7 else "x" * 400 for i in range(6000)))]
    got = line_dedup.remove_lines(awkward(frame(spark, rows)), run).drop("kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows, run)


def test_line_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        line_dedup.remove_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_substring_ids_may_be_of_any_kind(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got = substring_dedup.remove_repeats(spark.createDataFrame([("a", text), ("b", text), (None, "x")], "doc_id string, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == {"a": (40, 40, ""), "b": (40, 40, ""), None: (1, 0, "x")}


def test_parts_are_settled_one_by_one():
    """Records come part by part; rows that are passed on keep their place."""
    import pyarrow as pa

    kind = np.dtype("<i4")
    rows = [packed.deal(0, np.arange(10, dtype=kind), np.arange(10) % 3), packed.deal(0, np.arange(3, dtype=kind), np.zeros(3)), packed.deal(1, np.arange(2, dtype=kind), np.ones(2))]
    table = pa.Table.from_batches(rows).sort_by("part")
    got = list(packed.split(table.to_batches(), {0: kind}, (1,)))
    assert [sorted(g[0].tolist()) for g in got if isinstance(g, dict)] == [[0, 0, 1, 2, 3, 6, 9], [1, 4, 7], [2, 5, 8]]
    assert sum(g.num_rows for g in got if not isinstance(g, dict)) == 1
    assert list(packed.split([], {0: kind})) == []


def test_large_groups_join_by_broadcast(spark, monkeypatch):
    """Groups on either side of the bound, nulls and ties give the same rows."""
    g = random.Random(9)
    rows = [(i if g.random() > 0.1 else None, g.choice(["hot"] * 6 + [f"t{k}" for k in range(40)])) for i in range(500)] + EDGES
    wanted = None
    for hot in (1, 8, 4096):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        got = sorted(map(str, exact_dedup.decisions(frame(spark, rows)).collect()))
        wanted = wanted or got
        assert got == wanted


def test_registered_query_removes_single_lines(spark, tmp_path):
    rows = [(1, "once\ncommon"), (2, "common"), (3, "other\n\ncommon\nonce"), (4, "common")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_single_line_dedup"](spark, str(tmp_path)).collect()
    kept = {1: "once\ncommon", 2: "", 3: "other\n", 4: ""}
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == {d: (n, hashlib.sha256(kept[d].encode()).hexdigest()) for d, n in {1: 0, 2: 1, 3: 2, 4: 1}.items()}


def test_single_lines_match_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    oracle = duckdb.connect()
    oracle.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    wanted = oracle.sql(queries.ORACLE_SQL["op6_single_line_dedup"]).fetchall()
    got = queries.QUERIES["op6_single_line_dedup"](spark, sf).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(wanted) and sum(r[2] for r in wanted) > 0


def brute_groups(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    low_id = {}
    for i in range(len(rows)):
        known = low_id.get(find(i))
        low_id[find(i)] = rows[i][0] if known is None else known if rows[i][0] is None else min(known, rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), low_id[find(i)]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("members, hot", [(2048, 32), (16, 32), (16, 1)])
def test_near_copies_match_brute_force(spark, monkeypatch, members, hot):
    monkeypatch.setattr(ngram_join, "LEAST_HOT", hot)
    g = random.Random(7)
    base = [[f"b{k}_{i}" for i in range(50)] for k in range(3)]
    rows = []
    for d in range(150):
        words = list(g.choice(base))
        for _ in range(g.randint(0, 4)):
            words[g.randrange(50)] = f"m{g.randrange(300)}"
        rows.append((d, " ".join(words if g.random() < 0.7 else words[: g.randint(1, 50)])))
    rows += EDGES + [(None, rows[0][1]), (None, "nobody knows who wrote these few words")]
    got = ngram_join.similar_groups(awkward(frame(spark, rows)), most_members=members).collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows)


@pytest.mark.parametrize("dense", [1 << 26, 0])
def test_tree_finds_all_components(monkeypatch, dense):
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    g = np.random.default_rng(3)
    base = np.unique(g.integers(0, 2**60, 400, dtype=np.uint64))
    sets = []
    for _ in range(90):
        keep = base[g.random(len(base)) < g.choice([0.97, 0.8, 0.5])]
        sets.append(np.unique(np.concatenate([keep, g.integers(0, 2**60, g.integers(1, 60), dtype=np.uint64)])))
    links = ngram_join.links(sets, 75, np.arange(90))
    jaccard = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    up = list(range(90))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        assert jaccard(i, j) >= 0.75
        up[find(i)] = find(j)
    assert all(find(i) == find(j) for i in range(90) for j in range(i) if jaccard(i, j) >= 0.75)


def test_summaries_keep_every_link():
    """Sets that link are in one possible group, also across sizes of bitmaps; sets far from all others have none."""
    g = np.random.default_rng(4)
    sets, wide = [], np.unique(g.integers(0, 2**63, 1800, dtype=np.uint64))
    for n in (1400, 1500, 1530, 1540, 1600, 1800):  # bitmaps of 2,048 and of 16,384 bits
        sets.append(wide[:n])
    small = np.unique(g.integers(0, 2**63, 60, dtype=np.uint64))
    for _ in range(40):
        sets.append(np.unique(np.concatenate([small[g.random(len(small)) < 0.93], g.integers(0, 2**63, 3, dtype=np.uint64)])))
    alone = [np.unique(g.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 50, 1500, 3000)]
    sets += alone
    bits = [ngram_join.bitmap(s, ngram_join.bitmap_bits(len(s))) for s in sets]
    assert len({len(b) for b in bits}) == 2
    group = ngram_join.possible_groups(np.array([len(s) for s in sets]), bits, np.arange(len(sets)), 75)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                assert group[i] == group[j] >= 0
    assert (group[-len(alone) :] == -1).all()


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substring_dedup.remove_repeats(none).count() == 0
    assert line_dedup.remove_lines(none).count() == 0
    assert exact_dedup.decisions(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0
    assert ngram_join.similar_groups(none).count() == 0 and ngram_join.one_of_each(none).count() == 0
