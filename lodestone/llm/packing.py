"""Packing of documents into fixed-length sequences along a space-filling curve.

Each document's token ids give a hashed vector: every id adds a row of a fixed random
projection to ``DIMS`` dimensions. The mean is squashed to a grid and its Hilbert index is the
document's key, so documents of alike vocabulary lie near each other on the curve. Documents
are put in the order of (key, hash of the id), the ids of all documents form one stream in that
order, and the stream is cut at every multiple of the sequence length. Only the last sequence
is short.

How it runs: one pass tokenises each text once and stages (key, count, ids as 16- or 32-bit
numbers). Spark deals the staged rows by ranges of the curve, as many as the session has shuffle
partitions, sorts within each and stages them again with a running sum of counts; the key ends in
a hash of the document id and then in a number of the row, so rows that share a key are cut as
finely as any others. The total of each range, a row for each shuffle partition whatever the
input, gives the range its start in the stream; start and running sum are a document's place, and
from there each document's pieces follow without its neighbours. The ids shuffle once.

Defined cases: a null text is empty and consists of the closing id alone; documents with equal
id and text may change places but give the same pieces; a null id stays null; an empty table
gives no pieces; a text of any length is cut into as many pieces as it needs; other columns are
left alone.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import discard, partitions, stage

LENGTH = 1024
CLOSING = 0
DIMS = 4
BITS = 7
#: The pre-tokenisation rule of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, through a faster merge loop.

    The file's merges must be numbered in the order of their ids, which is checked here.
    Added tokens are found in the text first, as the library does.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items() if piece not in self.special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        ids = [vocab[m.replace(" ", "")] for m in merges]
        if ids != sorted(ids):
            raise ValueError("merges are not in the order of their ids")
        self.size = max([*ranks.values(), *self.special.values()]) + 1
        self._encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self._encoding.encode(text, allowed_special="all")
        return self._encoding.encode_ordinary(text)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.cache
def _projection(size: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, DIMS)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points, a row each, of any number of dimensions.

    Each bit plane, from the top, first undoes the rotation that the planes above imply
    (exchange or inversion of the low bits against dimension 0), then a Gray code runs over
    all bits, interleaved from the first dimension on.
    """
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for d in range(dims):
            set_ = (x[d] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        flip ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << one) | ((x[d] >> np.uint64(level)) & one)
    return out


def curve_key(ids: np.ndarray, size: int) -> np.ndarray:
    """Position on the grid of a document's hashed vector."""
    table = _projection(size)
    total = np.zeros(DIMS)
    for a in range(0, len(ids), 1 << 16):
        total += table[ids[a : a + (1 << 16)]].sum(axis=0)
    return np.clip((np.tanh(total / np.sqrt(len(ids)) / 4) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)


def tokenised(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged rows (doc_id, key, n, ids): curve key above a hash of the id, ids little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_file)
        kind = np.dtype("<u2") if e.size <= 1 << 16 else np.dtype("<u4")
        for b in batches:
            packed, counts, points = [], [], []
            for text in b.column(1):
                ids = np.array([*e.encode(text.as_py() or ""), CLOSING], kind)
                packed.append(ids.tobytes())
                counts.append(len(ids))
                points.append(curve_key(ids, e.size))
            keys = hilbert(np.array(points)) if points else np.empty(0, np.uint64)
            yield pa.record_batch([b.column(0), pa.array(keys.astype(np.int64)), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "curve", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, curve long, n long, ids binary")
    low = F.expr("xxhash64(cast(doc_id as string)) & 2147483647L")
    return stage(rows.withColumns({"key": F.shiftleft("curve", 31).bitwiseOR(low), "row": F.monotonically_increasing_id()}).drop("curve"), "packing-ids")


def along_curve(tokens: DataFrame) -> DataFrame:
    """Staged rows (doc_id, n, ids, range, before): documents dealt by ranges of the curve, with the ids
    that lie before each in its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            n = b.column("n").to_numpy()
            stop = before + np.cumsum(n)
            yield pa.record_batch([*b.columns, pa.array(stop - n, pa.int64())], names=[*b.schema.names, "before"])
            before = int(stop[-1]) if len(stop) else before

    kind = tokens.schema["doc_id"].dataType.simpleString()
    dealt = tokens.repartitionByRange(partitions(tokens.sparkSession), "key", "row").sortWithinPartitions("key", "row")
    tagged = dealt.select("doc_id", "n", "ids", F.spark_partition_id().alias("range"))
    return stage(tagged.mapInArrow(run, f"doc_id {kind}, n long, ids binary, range int, before long"), "packing-ranges")


def pieces(tokens: DataFrame, tokenizer_file: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: where it comes from, where it lies, and a CRC of its ids."""
    ranged = along_curve(tokens)
    discard(tokens)
    totals = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.sum("n")).collect())  # a row for each shuffle partition
    starts = dict(zip([r for r, _ in totals], np.cumsum([0, *(n for _, n in totals)])[:-1].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if encoder(tokenizer_file).size <= 1 << 16 else 4
        for b in batches:
            out: list[tuple] = []
            counts, places = b.column("n").to_pylist(), zip(b.column("range").to_pylist(), b.column("before").to_pylist(), strict=True)
            for row, (n, (part, before)) in enumerate(zip(counts, places, strict=True)):
                ids = memoryview(np.frombuffer(b.column("ids")[row].as_buffer(), f"<u{width}").astype("<u4").tobytes())
                at, start = starts[part] + before, 0
                while start < n:
                    offset = (at + start) % length
                    size = min(length - offset, n - start)
                    out.append((row, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, (at + start) // length, offset))
                    start += size
            if out:
                rows, *cols = (pa.array(c, pa.int64()) for c in zip(*out, strict=True))
                yield pa.record_batch([b.column("doc_id").take(rows), *cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return ranged.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pieces(tokenised(docs, tokenizer_file, id_col, text_col), tokenizer_file, length)
