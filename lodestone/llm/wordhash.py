"""Words of whole Arrow text columns as 64-bit hashes, without a Python object for each word.

Words are the maximal byte runs outside ``[\\x20\\x09-\\x0D]``. A word's hash is a
polynomial over its bytes, cut out of one running sum for the whole batch, and then
mixed with its length; words of over 512 bytes are hashed one by one instead, because a
polynomial modulo 2**64 is weak on very long inputs.

Defined cases: a null text is empty and has no words; so is a text of white space alone; texts and
words of any length are read in blocks, without a change of their hashes; an empty column has no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
WORD_BASE_2 = 0xD6E8FEB86659FD93 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LONG = 512
BLOCK = 1 << 20


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = np.ones(1, _U)
        self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.concatenate([np.ones(1, _U), np.full(size - 1, self.base, _U)]).cumprod(dtype=_U)
            self.down = np.concatenate([np.ones(1, _U), np.full(size - 1, self.inverse, _U)]).cumprod(dtype=_U)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _WORDS_2 = Powers(BYTE_BASE), Powers(WORD_BASE), Powers(WORD_BASE_2)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x + _U((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@dataclass
class Words:
    """Words of a batch: byte ranges in ``data``, hashes, and the first word of each row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray  # len(rows) + 1 word positions


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the byte offset of each row; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _words_in(data: np.ndarray, cuts: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words of some bytes; rows begin at the cuts."""
    n = len(data)
    inside = ~apart[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _BYTES.to(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE_VALUE[data] * up[:n], out=sums[1:])
    size = end - start
    h = mix((sums[end] - sums[start]) * down[start] + size.astype(_U) * _U(0xA24BAED4963EE407))
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return start, end, h


def words_of(column: pa.Array, lower: bool = False, apart: np.ndarray = _SPACE) -> Words:
    """Words of a text column. Works through the bytes in blocks that end between words.

    ``apart``: for each byte value, whether it stands between words; white space by default.
    """
    data, off = text_bytes(column)
    n = len(data)
    if lower:
        data = _LOWER[data]
    found, a = [], 0
    cuts = off[:-1]
    while a < n:
        b = min(n, a + BLOCK)
        while b < n and not (ends := np.flatnonzero(apart[data[b : b + 4096]])).size:
            b = min(n, b + 4096)
        b = min(n, b + int(ends[0])) if b < n else n
        inner = cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, b)] - a
        start, end, h = _words_in(data[a:b], inner, apart)
        found.append((start + a, end + a, h))
        a = b
    if not found:
        none = np.empty(0, np.int64)
        return Words(data, none, none, np.empty(0, _U), np.zeros(len(off), np.int64))
    start, end, h = (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(data, start, end, h, np.searchsorted(start, off))


class Ranges:
    """Hashes of word ranges of a batch, from running sums: ``of(a, b)`` hashes words a to b."""

    def __init__(self, h: np.ndarray, second: bool = False):
        n = len(h)
        up, self._down = (_WORDS_2 if second else _WORDS).to(n + 1)
        self._sums = np.zeros(n + 1, _U)
        np.cumsum(h * up[:n], out=self._sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self._sums[b] - self._sums[a]) * self._down[a] + (b - a).astype(_U) * _U(0x9FB21C651E98DF25))


def slices(batch: pa.RecordBatch, most: int) -> list[pa.RecordBatch]:
    """Zero-copy slices of a batch with at most ``most`` text bytes each (a longer row stands alone).

    The text is the batch's last column.
    """
    _, off = text_bytes(batch.column(batch.num_columns - 1))
    out, begin = [], 0
    while begin < batch.num_rows:
        stop = int(np.searchsorted(off, off[begin] + most, side="right")) - 1
        stop = min(max(stop, begin + 1), batch.num_rows)
        out.append(batch.slice(begin, stop - begin))
        begin = stop
    return out
