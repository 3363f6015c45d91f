"""Sharding against the published walk in plain Python, and its defined cases."""

import hashlib
import zlib

from lodestone.llm import sharding


def walk(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def hashed(doc_id):
    return hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()


def plain(rows, shards):
    out, places = [], {}
    order = lambda r: (walk(int(hashed(r[0])[:16], 16), shards), int(hashed(r[0])[16:24], 16) % sharding.BUCKETS, r[0] is not None, r[0] or 0)
    known = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows]
    for i, size, crc in sorted(known, key=lambda r: (*order(r), r[1], r[2])):
        key = int(hashed(i)[:16], 16)
        shard = walk(key, shards)
        out.append((i, size, crc, "key", shard, places.get(shard, 0), walk(key, shards + 1)))
        places[shard] = places.get(shard, 0) + 1
    return sorted(out, key=str)


def test_against_plain_code(spark):
    rows = [(i, "é" * (i % 50)) for i in range(400)] + [(7, "x")] * 5 + [(None, None), (None, ""), (None, None)] + [(-3, "y" * 100_000)]
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in rows], "doc_id long, text string, shard long, law string")
    for shards in (1, 5, 40, 300):
        got = sorted((tuple(r) for r in sharding.shards_of(docs, shards).collect()), key=str)
        assert got == plain(rows, shards)


def test_only_the_new_shard_takes_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'' AS text")
    one, more = ({r.doc_id: r for r in sharding.shards_of(docs, n).collect()} for n in (40, 41))
    assert all(more[i].shard == one[i].grown_shard and one[i].grown_shard in (one[i].shard, 40) for i in one)
    assert 30 < sum(one[i].grown_shard == 40 for i in one) < 130


def test_large_groups_of_equal_rows_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    docs = spark.range(500).selectExpr("1L AS doc_id", "'same' AS text")
    assert sorted(r.slot for r in sharding.shards_of(docs).collect()) == list(range(500))
    assert sharding.shards_of(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = sharding.shards_of(spark.range(5).selectExpr("id AS doc_id", "'a' AS text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
