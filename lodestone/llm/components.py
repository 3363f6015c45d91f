"""Connected components of a graph of long ids, by alternating large and small stars.

Defined cases: an edge from a node to itself is left out; repeated edges count once; no edges give
no components; a null end is no node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import discard, stage


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges with the smallest node it reaches by them, the smallest itself left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(nodes))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for x, y in zip(at[: len(a)], at[len(a) :], strict=True):
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)
    root = np.array([find(i) for i in range(len(nodes))], np.int64)
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, z = spanning(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield pa.record_batch([pa.array(a), pa.array(z)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes of ``edges(a, b)`` but the smallest of each component.

    A component is named by its smallest node. Edges shrink to spanning stars inside each
    batch first; then stars alternate until a round gives the same set of edges (as many, and none
    that was not there), in a number of rounds that grows with the logarithm of the longest path. Each round is staged in the shared folder. Minima
    are reduced in map tasks before they shuffle; a node with very many edges meets its minimum
    in a join that adaptive execution splits.
    """
    now = stage(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))  # every edge now leads to a smaller node
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        after = stage(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        done = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        discard(now)
        now = after
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
