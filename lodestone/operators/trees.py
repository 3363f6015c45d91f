"""Forests: sums over subtrees and paths, interval labels, and descendants as a range join.

Sums spread by pointer jumping: after k rounds a node has met 2**k levels, so rounds grow with
the logarithm of the depth, and a round moves a row for each node. Labels number the nodes so
that those below a node are the numbers between its own and its last (``pre < x <= last``): how many
there are is a difference, whether a node lies below another a comparison, and nothing of the
closure is made. Where pairs are wanted, an interval is cut into aligned blocks of powers of two up to
``2**LEVELS``, at most two of each smaller size, and a node names the blocks that hold it, so each pair meets in
exactly one block by an equality and no block holds more than ``2**LEVELS`` nodes.

Large groups: sums are reduced in map tasks; parents of more than a ``1 / HOT`` part of the nodes, fewer than
``HOT``, join by broadcast; siblings are numbered in ``BUCKETS`` buckets. Nothing else travels through the
driver: staged tables are small as files, and much larger as rows, so their joins are told to shuffle.

Defined cases: null ends and edges from a node to itself are left out, repeated edges count once; a node
with several parents is a ValueError; nodes on a cycle or below one never reach a root, have no label, and
come as a table of their own (``Labels.cyclic``); an empty table has no labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.staging import discard, stage

HOT = 4096
BUCKETS = 256
LEVELS = 12
_PAST = (Window.unboundedPreceding, -1)


def _wide(rows: DataFrame) -> DataFrame:
    """Rows that a join must not broadcast, however small their files are."""
    return rows.hint("merge")


def _met(rows: DataFrame, targets: DataFrame, key: str, every: int) -> DataFrame:
    """Rows joined to the targets of their ``key``; ``targets`` has ``__n``, how many rows name it."""
    hot = F.col("__n") * HOT > every
    names = [*rows.columns, *(c for c in targets.columns if c not in (key, "__n"))]
    marked = rows.join(F.broadcast(targets.where(hot).withColumn("__hot", F.lit(True))), key, "left")
    rest = marked.where("__hot IS NULL").select(*rows.columns).join(_wide(targets.where(~hot)), key)
    return marked.where("__hot").select(*names).unionByName(rest.select(*names))


def forest(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Rows (node, parent) of all nodes of ``edges(parent, node)`` and of ``nodes(node)``, staged; parent null at the top."""
    own = edges.select("node", "parent").where("parent <> node").distinct()
    above = own.select(F.col("parent").alias("node"))
    every = (above if nodes is None else above.unionByName(nodes.select("node").where("node IS NOT NULL"))).select("node", F.lit(None).cast(own.schema["parent"].dataType).alias("parent"))
    # a node's own edge and the rows that only name it meet in one group
    out = stage(own.unionByName(every).groupBy("node").agg(F.max("parent").alias("parent"), F.count_if(F.col("parent").isNotNull()).alias("__p")), "forest")
    if not out.where("__p > 1").isEmpty():
        raise ValueError("a node has several parents")
    return out.drop("__p")


def subtree_sums(nodes: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (node, *values) with sums over each node's subtree, itself included, and rows (node) that reach no top.

    ``nodes(node, parent, *values)``. In round k a pointer names the ancestor 2**k levels up and the sums hold 2**k levels below.
    """
    now, before = stage(nodes.select("node", F.col("parent").alias("up"), *values), "tree-round"), -1
    while (every := now.where("up IS NOT NULL").count()) and every != before:
        before = every
        below = now.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(f"__{v}") for v in values], F.count(F.lit(1)).alias("__n"))
        met = stage(now.join(_wide(below), "node", "left"), "tree-met")
        targets = met.where("__n IS NOT NULL").select(F.col("node").alias("up"), F.col("up").alias("__next"), "__n")
        summed = [(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values]
        jumped = _met(met.where("up IS NOT NULL").drop("__n"), targets, "up", every).select("node", F.col("__next").alias("up"), *summed)
        after = stage(met.where("up IS NULL").select("node", "up", *summed).unionByName(jumped), "tree-round")
        discard(met)
        discard(now)
        now = after
    return now.where("up IS NULL").drop("up"), now.where("up IS NOT NULL").select("node")


def path_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Rows (node, top, *values) with sums over each node's path from the top, itself included, and the top's name.

    ``nodes(node, parent, *values)``; nodes that reach no top are left out.
    """
    now, before = stage(nodes.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.col("node")).alias("top"), *values), "tree-round"), -1
    while (every := now.where("up IS NOT NULL").count()) and every != before:
        before = every
        asked = now.where("up IS NOT NULL")
        counts = asked.groupBy("up").agg(F.count(F.lit(1)).alias("__n"))
        targets = now.select(F.col("node").alias("up"), F.col("up").alias("__next"), F.col("top").alias("__top"), *[F.col(v).alias(f"__{v}") for v in values]).join(_wide(counts), "up")
        jumped = _met(asked, targets, "up", every).select("node", F.col("__next").alias("up"), F.col("__top").alias("top"), *[(F.col(v) + F.col(f"__{v}")).alias(v) for v in values])
        after = stage(now.where("up IS NULL").unionByName(jumped), "tree-round")
        discard(now)
        now = after
    return now.where("up IS NULL").drop("up")


@dataclass
class Labels:
    """Rows (node, parent, top, depth, pre, last), depth from 0, and rows (node) on or below a cycle."""

    rows: DataFrame
    cyclic: DataFrame


def labels(edges: DataFrame, nodes: DataFrame | None = None) -> Labels:
    """Interval labels of a forest: the nodes below one are those of its top with ``pre < x.pre <= last``."""
    own = forest(edges, nodes)
    sizes, cyclic = subtree_sums(own.withColumn("size", F.lit(1).cast("long")), ["size"])
    sized = stage(own.join(_wide(sizes), "node").withColumn("__b", F.pmod(F.xxhash64("node"), F.lit(BUCKETS))), "tree-sizes")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(*_PAST)), F.lit(0))
    below = sized.where("parent IS NOT NULL")
    starts = below.groupBy("parent", "__b").agg(F.sum("size").alias("s")).select("parent", "__b", before(Window.partitionBy("parent").orderBy("__b"), "s").alias("start"))
    placed = below.join(_wide(starts), ["parent", "__b"]).select("node", "parent", "size", (F.col("start") + before(Window.partitionBy("parent", "__b").orderBy("node"), "size") + 1).alias("step"))
    tops = sized.where("parent IS NULL").select("node", "parent", "size", F.lit(0).cast("long").alias("step"))
    steps = stage(placed.unionByName(tops).withColumn("depth", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long")), "tree-steps")
    paths = path_sums(steps.select("node", "parent", "step", "depth"), ["step", "depth"])
    rows = steps.select("node", "parent", "size").join(_wide(paths), "node")
    return Labels(stage(rows.select("node", "parent", "top", "depth", F.col("step").alias("pre"), (F.col("step") + F.col("size") - 1).alias("last")), "tree-labels"), cyclic)


def counts(found: Labels) -> DataFrame:
    """Per node with something below it: (node, child_count, descendant_count), from labels alone."""
    children = found.rows.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("child_count"))
    return found.rows.join(_wide(children), "node").select("node", "child_count", (F.col("last") - F.col("pre")).alias("descendant_count"))


def _blocks(begin: Column, end: Column) -> Column:
    """The aligned blocks (size, number) that [begin, end) is cut into, at most two of each power of two below the largest."""
    zero = F.lit(0).cast("long")
    kind = "array<struct<size:bigint,at:bigint>>"
    state = F.struct(begin.alias("a"), end.alias("z"), F.array().cast(kind).alias("out"))

    def halves(s: Column, k: Column) -> Column:
        # at level k the ends are block numbers; an odd begin or end leaves one block of this size behind
        left = (s["a"] < s["z"]) & (s["a"] % 2 == 1)
        a = F.when(left, s["a"] + 1).otherwise(s["a"])
        right = (a < s["z"]) & (s["z"] % 2 == 1)
        z = F.when(right, s["z"] - 1).otherwise(s["z"])
        block = lambda at: F.array(F.struct(k.cast("long").alias("size"), at.alias("at")))
        none = F.array().cast(kind)
        out = F.concat(s["out"], F.when(left, block(s["a"])).otherwise(none), F.when(right, block(z)).otherwise(none))
        return F.struct(F.floor(a / 2).cast("long").alias("a"), F.floor(z / 2).cast("long").alias("z"), out.cast(kind).alias("out"))

    def largest(s: Column) -> Column:
        whole = F.transform(F.sequence(s["a"], s["z"] - 1), lambda at: F.struct(F.lit(LEVELS).cast("long").alias("size"), at.alias("at")))
        return F.concat(s["out"], F.when(s["a"] < s["z"], whole).otherwise(F.array().cast(kind)).cast(kind))

    return F.aggregate(F.sequence(zero, F.lit(LEVELS - 1).cast("long")), state, halves, largest)


def pairs(found: Labels) -> DataFrame:
    """All (ancestor, node, depth) with the number of levels between, from labels: no closure is computed, only given out."""
    rows = found.rows
    cut = rows.where("last > pre").select(F.col("node").alias("ancestor"), "top", F.col("depth").alias("__from"), F.inline(_blocks(F.col("pre") + 1, F.col("last") + 1)))
    most = rows.agg(F.coalesce(F.max("last"), F.lit(0)).alias("m")).scalar()
    inside = rows.where("parent IS NOT NULL").withColumn("__k", F.explode(F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(most + 1)).cast("int")))))
    held = inside.select("node", "top", "depth", F.col("__k").cast("long").alias("size"), F.floor(F.col("pre") / F.pow(F.lit(2.0), F.col("__k"))).cast("long").alias("at"))
    return cut.join(_wide(held), ["top", "size", "at"]).select("ancestor", "node", (F.col("depth") - F.col("__from")).cast("int").alias("depth"))
