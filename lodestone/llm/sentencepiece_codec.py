"""SentencePiece encoding that keeps byte offsets, and decoding.

``Normaliser`` walks the text and, at each place, replaces the longest prefix that the
model's compiled character map knows (a double-array trie) or takes one character as it is.
For every byte that it writes it records the source bytes that the byte came from, so each
piece of the segmented text projects back to a span of the original text in UTF-8.

The normalised text then goes whole through the merge loop of the library, on a copy of the
model whose own normaliser is switched off, and the lengths of the pieces lay them over the
normalised bytes.

Defined cases: null counts as empty; an empty text has no tokens and decodes to ''. Repeated
rows give repeated results, other columns are left alone, and an empty table gives an empty
result. Models with user-defined symbols are refused.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


class CharacterMap:
    """The compiled character map: a double-array trie and its replacement strings."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit >> 6) & 8)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix at a byte position, and its replacement."""
        if not self.units:
            return None
        node, found, i = self._jump(self.units[0]), None, at
        while i < len(data):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            i += 1
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                found = i - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class Normaliser:
    """Longest-prefix normalisation with the source alignment of every written byte."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.space = MARK.encode() if self.escape else b" "

    @property
    def plain(self) -> bool:
        """Whether only spaces change, one for one."""
        return not self.map.units and not self.squeeze and self.escape

    def _steps(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < len(data):
            known = self.map.longest(data, at)
            if known:
                size, out = known
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out = data[at : at + size]
            yield at, at + size, out
            at += size

    def text(self, text: str) -> str:
        if not self.plain:
            return self.aligned(text)[0].decode()
        return (" " * (self.dummy and bool(text)) + text).replace(" ", MARK)

    def aligned(self, text: str) -> tuple[bytes, list[int], list[int]]:
        """Normalised bytes; of each of them the source span: first byte and end."""
        out, begin, end = bytearray(), [], []

        def put(piece: bytes, a: int, b: int) -> None:
            out.extend(piece)
            begin.extend([a] * len(piece))
            end.extend([b] * len(piece))

        after_space, started = self.squeeze, False
        for a, b, piece in self._steps(text.encode()):
            if after_space and self.squeeze:
                piece = piece.lstrip(b" ")
            if not piece:
                continue
            if not started and self.dummy:
                put(self.space, a, a)
            started = True
            after_space = piece.endswith(b" ")
            for ch in piece.decode():
                put(self.space if ch == " " else ch.encode(), a, b)
        if self.squeeze:
            while out.endswith(self.space) and out:
                del out[-len(self.space) :], begin[-len(self.space) :], end[-len(self.space) :]
        return bytes(out), begin, end

    def bounds(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The spans of ``aligned``; where only spaces change, by running sums over the bytes."""
        if not self.plain:
            _, begin, end = self.aligned(text)
            return np.array(begin, np.int64), np.array(end, np.int64)
        data = np.frombuffer(text.encode(), np.uint8)
        first = np.flatnonzero(data & 0xC0 != 0x80)
        size = np.diff(first, append=len(data))
        width = np.where(data[first] == 0x20, len(self.space), size)
        front = np.zeros(len(self.space) * (self.dummy and bool(text)), np.int64)
        return np.concatenate([front, np.repeat(first, width)]), np.concatenate([front, np.repeat(first + size, width)])


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        if any(p.type == _USER for p in model.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        spec = model.normalizer_spec
        self.normaliser = Normaliser(spec)
        self.strip = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.strip_all = spec.remove_extra_whitespaces
        self.types = [p.type for p in model.pieces]
        self.pieces = [p.piece for p in model.pieces]
        self.unknown = model.trainer_spec.unk_surface
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self._sizes = np.array([1 if t == _BYTE else len(p.encode()) for t, p in zip(self.types, self.pieces, strict=True)], np.int64)
        self._decimal = [str(i) for i in range(len(self.pieces))]
        self._shown = {i: p.replace(MARK, " ") for i, p in enumerate(self.pieces) if self.types[i] == _NORMAL}

    def encode(self, text: str | None) -> list[int]:
        return self.segmenter.encode(self.normaliser.text(text or ""))

    def encode_spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token: bytes of the original text; byte tokens share their character's span."""
        ids, starts, ends = self.spans(text)
        return list(zip(ids, starts.tolist(), ends.tolist(), strict=True))

    def spans(self, text: str | None, unknown: bool = False) -> tuple[list[int], np.ndarray | None, np.ndarray | None]:
        """Ids, starts and ends of ``encode_spans``; no spans at an unknown token if ``unknown``."""
        ids = self.encode(text)
        if any(self.types[i] == _UNKNOWN for i in set(ids)):
            if unknown:
                return ids, None, None
            raise ValueError("spans need a model with byte fallback")
        begin, end = self.normaliser.bounds(text or "")
        size = self._sizes[np.array(ids, np.int64)]
        stop = np.cumsum(size)
        return ids, begin[stop - size], end[stop - 1]

    def decode(self, ids: list[int], begin: bool = True) -> str:
        """Text of the ids. ``begin``: the ids start a text, so the prefix mark goes."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            kind = self.types[i]
            if kind == _BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(_lenient(held))
                held.clear()
            piece = "" if kind == _CONTROL else self.unknown if kind == _UNKNOWN else self.pieces[i]
            if begin and self.strip and kind == _NORMAL and not any(out) and piece.startswith(MARK):
                piece = piece[1:]
                begin = self.strip_all
            out.append(piece.replace(MARK, " "))
            begin = begin and not any(out)
        if held:
            out.append(_lenient(held))
        return "".join(out)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as decimals joined by commas, SHA-256 of the decoded text."""
        return self._digest(self.encode(text))

    def digest_spans(self, text: str | None) -> tuple[int, str, str, str | None]:
        """``digest`` and the SHA-256 of the starts and then the ends of all tokens as 64-bit
        little-endian numbers; null where a token is unknown, as it has no span."""
        ids, starts, ends = self.spans(text, unknown=True)
        spans = None if starts is None else hashlib.sha256(np.concatenate([starts, ends]).astype("<i8").tobytes()).hexdigest()
        return *self._digest(ids), spans

    def _digest(self, ids: list[int]) -> tuple[int, str, str]:
        decimal, shown = self._decimal, self._shown
        try:
            back = "".join([shown[i] for i in ids])
            if ids and self.strip and back.startswith(" "):
                back = back.lstrip(" ") if self.strip_all else back[1:]
        except KeyError:  # bytes, unknown or control pieces
            back = self.decode(ids)
        return len(ids), hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def _lenient(data: bytearray) -> str:
    """UTF-8 where it is valid, one replacement character for each other byte."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(data[at : at + size]).decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.cache
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode_column(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, starts, ends (byte spans of the original text)."""

    def run(batches):
        c = codec(model_file)
        for b in batches:
            for row in range(b.num_rows):  # a batch for each document: its tokens may be many
                got = c.encode_spans(b.column(1)[row].as_py())
                cols = [[[g[k] for g in got]] for k in range(3)]
                yield pa.record_batch([b.column(0).slice(row, 1), *(pa.array(v, pa.list_(pa.int32())) for v in cols)], names=["doc_id", "ids", "starts", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def digest_column(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256.

    Encodes and decodes every whole text in one narrow pass; nothing shuffles.
    """

    def run(batches):
        c = codec(model_file)
        for b in batches:
            got = [c.digest_spans(t.as_py()) for t in b.column(1)]
            cols = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), *(pa.array([g[k] for g in got], pa.string()) for k in (2, 3))]
            yield pa.record_batch([b.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
