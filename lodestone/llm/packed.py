"""Packed shuffles: numpy records dealt to partitions as one binary cell for each target.

Spark moves few, large cells in place of millions of small rows; the tasks on either side
sort and group the records as arrays. The rows are ``(what, part, data)``.

Records are dealt to ``FINE`` parts for each partition. A task gets its parts one after the
other, sorted by Spark (which spills), and holds the records of one part only.

Defined cases: no rows give no records; equal records stay; a part without records is skipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "what int, part int, data binary"
FINE = 4
FILTER_WORDS = 1 << 18


def deal(what: int, records: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Records as a row for each target part that gets any."""
    part = part.astype(np.int64)
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.empty(0, np.int64)
    ends = [*cuts[1:], len(part)]
    return pa.record_batch(
        [
            pa.array([what] * len(cuts), pa.int32()),
            pa.array(part[cuts], pa.int32()),
            pa.array([records[a:b].tobytes() for a, b in zip(cuts, ends, strict=False)], pa.binary()),
        ],
        names=["what", "part", "data"],
    )


def by_part(df: DataFrame, parts: int, *then: str) -> DataFrame:
    """Rows with part p in partition p % ``parts``, in the order of the parts and of further columns."""
    return df.repartitionById(parts, F.col("part") % parts).sortWithinPartitions("part", *then)


def stretches(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of the stretches of equal parts of a batch."""
    cuts = np.flatnonzero(np.diff(parts)) + 1
    edges = [0, *cuts.tolist(), len(parts)]
    for a, z in zip(edges, edges[1:], strict=False):
        if z > a:
            yield int(parts[a]), a, z


def split(batches: Iterable[pa.RecordBatch], kinds: dict[int, np.dtype], passed: tuple[int, ...] = ()) -> Iterator[pa.RecordBatch | dict]:
    """Yields the rows whose ``what`` is passed on as they come, and the records of each other kind part by part."""
    held: dict[int, list[np.ndarray]] = {k: [] for k in kinds}
    at = None

    def closed() -> dict:
        out = {k: np.concatenate(v) if v else np.empty(0, kinds[k]) for k, v in held.items()}
        for v in held.values():
            v.clear()
        return out

    for b in batches:
        whats, parts = b.column(0).to_numpy(), b.column(1).to_numpy()
        keep = np.isin(whats, passed)
        if keep.any():
            yield b.filter(pa.array(keep))
        for i in np.flatnonzero(~keep):
            if parts[i] != at:
                if any(held.values()):
                    yield closed()
                at = parts[i]
            kind = int(whats[i])
            if kind in kinds:
                held[kind].append(np.frombuffer(b.column(2)[i].as_buffer(), kinds[kind]))
    if any(held.values()):
        yield closed()


def _place() -> tuple[Column, Column]:
    return F.expr(f"key & {FILTER_WORDS - 1}L"), F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 40) & 63 as int))")


def key_filter(keys: DataFrame) -> DataFrame:
    """A Bloom filter of a column ``key`` of 64-bit hashes: words with their bits, 4 MB at most."""
    word, bit = _place()
    return keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))


def flagged(keyed: DataFrame, keys: DataFrame, flag: str) -> DataFrame:
    """Adds a column that is false for rows of ``keyed`` whose ``key`` surely isn't among ``keys``.

    The filter is the only broadcast, ``FILTER_WORDS`` words whatever the input. As long as few
    keys are wanted most rows stay where they are; when it fills up, more rows count as possible
    ones and the results are the same.
    """
    word, bit = _place()
    tested = keyed.withColumn("__word", word).join(F.broadcast(key_filter(keys)), "__word", "left")
    return tested.select(*keyed.columns, F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False)).alias(flag))


def parted(keyed: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``keyed`` whose ``key`` may be among ``keys``, and the rows whose key surely isn't."""
    tested = flagged(keyed, keys, "__maybe")
    return tested.where("__maybe").select(*keyed.columns), tested.where("NOT __maybe").select(*keyed.columns)
