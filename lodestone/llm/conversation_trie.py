"""The trie of conversation prefixes: what the turns that conversations share would save.

A conversation is a sequence of turns (role, text). Each distinct sequence of first turns is a node,
named by a digest of 128 bits: the exclusive or of a hash of every turn with its depth. So a node's
parent is named from the node itself, by taking its last turn's hash out again, and prefixes of a
conversation are running exclusive ors, in chunks of bounded length. Leaf counts and savings reach
all ancestors by pointer jumping: in each round a node adds to the ancestor that its pointer names
what it has gathered so far, and the pointer then jumps to that ancestor's own. Rounds grow with
the logarithm of the depth, and each is staged.

Large groups: turns are numbered in ranges of a sorted table, so a conversation with any share of all
rows is in no single task; equal rows are counted before they shuffle. Nodes and sums are reduced in
map tasks first. Parents of more than a ``1 / HOT`` part of the nodes, fewer than ``HOT``, join by broadcast.
The ids at a node's end are hashed in sorted pieces that stream through; the hash of one list is
sequential by nature, but no list is ever held.

Defined cases: rows without a conv_id belong to no conversation and are left out. Turns go by number,
nulls first; turns of one number by the SHA-256 of role and text. Null roles and texts are empty, and
repeated rows are turns of their own. A conversation all of whose turns fall away is a member of the
root only. The remainder of a negative conv_id is negative, as in SQL. An empty table gives no node,
not even a root. Texts of any length count whole. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.exact_dedup import joined_groups
from lodestone.llm.storage import discard, partitions, stage, whole_number_ids

HEAD_MOST = 6
BASE_EVERY = 100
CHUNK = 1024
PIECE_IDS = 1 << 16
_BEFORE = (Window.unboundedPreceding, -1)


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of the SHA-256 of a turn's role and text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in order: rows (conv_id, part, first, n, turn_hash, chars), n equal turns from number ``first`` on,
    and rows (conv_id, part, start, total): how many turns stand before a part, and how many there are."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = conversations.select(
        whole_number_ids(conversations, "conv_id").alias("conv_id"), F.col("turn").isNotNull().alias("has"), "turn",
        turn_digest(role, text).alias("turn_hash"), F.length(text).cast("long").alias("chars"),
    ).where("conv_id IS NOT NULL")
    order = ["has", "turn", "turn_hash"]
    equal = narrow.groupBy("conv_id", *order).agg(F.max("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    ranged = stage(equal.repartitionByRange(partitions(equal.sparkSession), "conv_id", *order).withColumn("part", F.spark_partition_id()), "turn-ranges")
    sums = ranged.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("conv_id")
    starts = stage(sums.select("conv_id", "part", F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(*_BEFORE)), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("total")), "turn-starts")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(*_BEFORE)), F.lit(0))
    turns = ranged.join(starts.select("conv_id", "part", "start"), ["conv_id", "part"])
    return stage(turns.select("conv_id", "part", (F.col("start") + inside).alias("first"), "n", "turn_hash", "chars"), "turns"), starts


def _exploded(rows: DataFrame, begin: str, end: str) -> DataFrame:
    """A row for each number ``i`` from ``begin`` up to but not including ``end``, in arrays of bounded length."""
    runs = rows.where(f"{begin} < {end}").withColumn("__c", F.explode(F.expr(f"sequence(0L, ({end} - {begin} - 1) div {PIECE_IDS})")))
    return runs.withColumn("i", F.explode(F.expr(f"sequence({begin} + __c * {PIECE_IDS}, least({end}, {begin} + (__c + 1) * {PIECE_IDS}) - 1)"))).drop("__c")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the head of their hundred's first one: rows (conv_id, depth, turn_hash, chars, length), depth from 1,
    and rows (conv_id, length) of all conversations."""
    turns, starts = numbered(conversations)
    heads = _exploded(turns.where((F.col("conv_id") % BASE_EVERY == 0) & (F.col("first") < HEAD_MOST - 1)).withColumn("__end", F.expr(f"least(first + n, {HEAD_MOST - 1}L)")), "first", "__end")
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "turn_hash", "chars"))).alias("head"))  # at most five turns
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_MOST
    asked = starts.select("*", (F.col("conv_id") - F.col("conv_id") % BASE_EVERY).alias("base"), share.alias("h"))
    met = asked.join(heads, "base", "left").withColumn("head", F.expr("slice(coalesce(head, array()), 1, cast(h as int))"))
    plans = stage(met.select("conv_id", "part", "start", "h", "head", F.size("head").cast("long").alias("taken"), (F.size("head") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")), "turn-plans")
    one = plans.where("start = 0")
    given = one.select("conv_id", "length", F.posexplode("head").alias("at", "t")).select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "t.turn_hash", "t.chars", "length")
    own = turns.join(plans.select("conv_id", "part", "h", "taken", "length"), ["conv_id", "part"]).withColumns({"__from": F.greatest("first", "h"), "__end": F.col("first") + F.col("n")})
    own = _exploded(own, "__from", "__end").select("conv_id", (F.col("taken") + F.col("i") - F.col("h") + 1).alias("depth"), "turn_hash", "chars", "length")
    return stage(given.unionByName(own), "rebuilt"), one.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, node, parent, chars, length): the nodes that each conversation passes. The root is (0, 0)."""
    hashed = turns.select("*", F.xxhash64("depth", "turn_hash", F.lit(1)).alias("h1"), F.xxhash64("depth", "turn_hash", F.lit(2)).alias("h2"), F.expr(f"depth div {CHUNK}").alias("chunk"))
    sums = hashed.where(f"length >= {CHUNK}").groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    past = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(*_BEFORE)
    before = sums.select("conv_id", "chunk", F.bit_xor("x1").over(past).alias("b1"), F.bit_xor("x2").over(past).alias("b2"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = hashed.withColumns({f"r{k}": F.bit_xor(f"h{k}").over(inside) for k in "12"}).join(before, ["conv_id", "chunk"], "left")
    at = run.withColumns({f"p{k}": F.col(f"r{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in "12"})
    parent = F.when(F.col("depth") == 1, F.struct(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2")))
    parent = parent.otherwise(F.struct(F.col("p1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("p2")))
    return at.select("conv_id", "depth", F.struct("p1", "p2").alias("node"), parent.alias("parent"), "chars", "length")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Rows (node, *values): sums over each node's subtree, itself included.

    ``nodes(node, parent, *values)``, parent null at the top. In round k a pointer names the ancestor
    2**k levels up and the sums hold the 2**k levels below.
    """
    now = stage(nodes.select("node", F.col("parent").alias("up"), *values), "trie-round")
    while every := now.where("up IS NOT NULL").count():
        below = now.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(f"__{v}") for v in values], F.count(F.lit(1)).alias("__n"))
        met = stage(now.join(below, "node", "left"), "trie-met")
        targets = met.where("__n IS NOT NULL").select(F.col("node").alias("up"), F.col("up").alias("next"), "__n")
        summed = [(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values]
        jumped = joined_groups(met.where("up IS NOT NULL"), targets.withColumnRenamed("__n", "__pointers"), "__pointers", every, "up").select("node", F.col("next").alias("up"), *summed)
        done = met.where("up IS NULL").select("node", "up", *summed)
        after = stage(done.unionByName(jumped), "trie-round")
        discard(met)
        discard(now)
        now = after
    return now.drop("up")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (p1, p2, conv_id) to one digest for each node that lies inside the partition, and to pieces of
    the decimal ids of its first and last node, which may go on in another partition."""
    node, held, kept, opened = None, [], [], False

    def piece() -> None:
        ids = np.concatenate(held)
        kept.append((*node, int(ids[0]), ",".join(map(str, ids.tolist())), None))
        held.clear()

    def flushed() -> pa.RecordBatch:
        rows = list(zip(*kept, strict=True)) if kept else [[]] * 5
        kept.clear()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["p1", "p2", "first", "ids", "digest"])

    for b in batches:
        if not b.num_rows:
            continue
        a, z, ids = (c.to_numpy() for c in b.columns)
        cuts = np.flatnonzero((a[1:] != a[:-1]) | (z[1:] != z[:-1])) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)], strict=True):
            key = (int(a[begin]), int(z[begin]))
            if node is not None and key != node:
                if opened:  # neither the first node of the partition nor, now, its last
                    kept.append((*node, None, None, hashlib.sha256(",".join(map(str, np.concatenate(held).tolist())).encode()).hexdigest()))
                    held.clear()
                elif held:
                    piece()
                opened = True
            node = key
            held.append(ids[begin:end])
            if sum(map(len, held)) > PIECE_IDS:
                piece()
                opened = False  # part of its ids has left already
        yield flushed()
    if held:
        piece()
    yield flushed()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces (p1, p2, first, ids) to a digest for each node."""
    node, digest = None, None
    found = []

    def flushed() -> pa.RecordBatch:
        rows = list(zip(*found, strict=True)) if found else [[]] * 3
        found.clear()
        return pa.record_batch([pa.array(r, k) for r, k in zip(rows, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["p1", "p2", "digest"])

    for b in batches:
        for a, z, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (a, z) != node:
                if node is not None:
                    found.append((*node, digest.hexdigest()))
                node, digest = (a, z), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield flushed()
    if node is not None:
        found.append((*node, digest.hexdigest()))
    yield flushed()


def ends_digests(ends: DataFrame) -> DataFrame:
    """Rows (node, ends_sha256) from rows (node, conv_id): the hash of the ascending ids, joined by commas."""
    spark = ends.sparkSession
    flat = ends.select("node.p1", "node.p2", "conv_id").repartitionByRange(partitions(spark), "p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id")
    found = stage(flat.mapInArrow(_pieces, "p1 long, p2 long, first long, ids string, digest string"), "trie-ends")
    open_ = found.where("digest IS NULL").drop("digest").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first")
    every = found.where("digest IS NOT NULL").select("p1", "p2", "digest").unionByName(open_.mapInArrow(_streamed, "p1 long, p2 long, digest string"))
    return every.select(F.struct("p1", "p2").alias("node"), F.col("digest").alias("ends_sha256"))


def trie(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one for each node."""
    turns, lengths = rebuilt(conversations)
    passed = stage(prefixes(turns), "prefixes")
    zero = F.lit(0).cast("long")
    top = F.struct(zero.alias("p1"), zero.alias("p2"))
    no = F.lit(None).cast("struct<p1:bigint,p2:bigint>")
    columns = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")]
    inner = passed.groupBy("node").agg(*columns, F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("chars").alias("chars"))
    root = lengths.agg(*columns).where("n_convs > 0").select(top.alias("node"), "conv_id", "n_convs", zero.alias("depth"), no.alias("parent"), zero.alias("chars"))
    bare = stage(inner.unionByName(root), "trie-nodes")
    counts = bare.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(bare.join(counts, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-nodes")
    own = nodes.select("node", F.when(F.col("parent") != top, F.col("parent")).alias("parent"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    below = subtree_sums(own.where(F.col("node") != top), ["n_leaves", "saved_tokens"])
    whole = own.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).where("n_leaves IS NOT NULL").select(top.alias("node"), "n_leaves", "saved_tokens")
    ended = passed.where("depth = length").select("node", "conv_id").unionByName(lengths.where("length = 0").select(top.alias("node"), "conv_id"))
    full = nodes.join(below.unionByName(whole), "node").join(ends_digests(ended), "node", "left")
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__children"))
    named = joined_groups(full.where("parent IS NOT NULL"), parents, "__children", nodes.count(), "parent").drop("__children")
    out = named.unionByName(full.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
