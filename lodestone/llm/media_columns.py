"""Media columns: payloads as lossless 8-bit images in archives, read by a custom data source.

``pack_media`` writes each payload as a grey PNG of 64 samples a row into ZIP archives, one or
more for each task, through the writer of the data source ``media_archive``. A task writes
under a name of its own attempt; each commit lists the files of the tasks that succeeded in a
manifest of its own, so what a lost or repeated task left behind is never read, an append adds to
what is there, and a commit is there whole or not at all. Overwriting first drops the manifests
of before; a write that fails takes its archives away.

The reader plans on the driver from the manifests alone (path and size of each archive) and
cuts every archive into byte ranges of at most ``split`` bytes. A task reads the archive's
directory at its end, takes the members whose header begins in its range, and streams their
payloads in Arrow batches of at most 4 MB. Each member is checked against its CRC and, if the
read fails or is short, is read again by its own offset, up to ``retries`` times, without the
members around it. ``on_error`` says whether a member that stays unreadable fails the task
('fail') or becomes a row with a null payload and the error's text ('null').

Defined cases: a null text is an empty payload of 64 zero bytes; repeated rows are stored
twice; a null id stays null; ids must be whole numbers, others are refused; other columns are left
alone; an empty table gives an empty archive folder and no rows. A payload of any length is one member (ZIP64 where needed).
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lodestone.llm.storage import fresh_folder, whole_number_ids

WIDTH = 64
SPLIT = 32 << 20
ARCHIVE = 128 << 20
_BATCH = 4 << 20
_SIGN = b"\x89PNG\r\n\x1a\n"
_MANIFEST = "manifest-"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(raw: bytes, level: int = 1) -> bytes:
    """A grey 8-bit PNG of 64 samples a row: the bytes, padded, and their own length as a text chunk."""
    payload = padded(raw)
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    length = b"Length\0%d" % len(raw)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"tEXt", length) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """The samples of an image that ``to_png`` wrote, and the length without padding; anything else is an error."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, packed, width, length = 8, [], 0, -1
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, _, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only grey 8-bit images without interlace are read")
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("only rows without a filter are read")
    return rows[:, 1:].tobytes(), length


def padded(raw: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def features(payload: bytes) -> str:
    """Mean, spread, mean step between neighbouring samples, and entropy of the samples in bits."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    values = np.arange(256)
    mean = float((n * values).sum() / len(x))
    spread = float(np.sqrt(max(0.0, (n * values * values).sum() / len(x) - mean * mean)))
    step = float(np.abs(np.diff(x.astype(np.int16))).mean()) if len(x) > 1 else 0.0
    return f"mean={mean:.4f};std={spread:.4f};step={step:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


@dataclass
class _Range(InputPartition):
    path: str
    begin: int
    stop: int


class _ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.folder, self.most, self.overwrite = options["path"], int(options.get("archive", ARCHIVE)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = _filesystem(self.folder)
        store.create_dir(folder, recursive=True)
        files, out, archive, number = [], None, None, 0

        def close():
            nonlocal out, archive
            if archive is not None:
                archive.close()
                size = out.tell()
                out.close()
                files.append((name, size))
            out = archive = None

        for batch in iterator:
            ids, payloads = batch.column("id"), batch.column("payload")
            for i in range(batch.num_rows):
                if archive is None:
                    name = f"part-{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{folder}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                key = ids[i].as_py()
                entry = zipfile.ZipInfo(f"{number}/{'' if key is None else key}.png")
                archive.writestr(entry, to_png(payloads[i].as_py() or b""))
                number += 1
                if out.tell() > self.most:
                    close()
        close()
        return _Written(files)

    def commit(self, messages) -> None:
        store, folder = _filesystem(self.folder)
        store.create_dir(folder, recursive=True)
        old = manifests(store, folder) if self.overwrite else []
        name = f"{folder}/{_MANIFEST}{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())
        store.move(f"{name}.part", name)
        for path in old:
            gone = listed_archives(store, path)
            store.delete_file(path)
            for archive, _ in gone:
                store.delete_file(f"{folder}/{archive}")

    def abort(self, messages) -> None:
        store, folder = _filesystem(self.folder)
        for archive, _ in (f for m in messages if m for f in m.files):
            store.delete_file(f"{folder}/{archive}")


def manifests(store, folder: str) -> list[str]:
    """Paths of the committed manifests of a folder, oldest first."""
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(i.path for i in found if i.base_name.startswith(_MANIFEST) and i.base_name.endswith(".json"))


def listed_archives(store, path: str) -> list[tuple[str, int]]:
    with store.open_input_stream(path) as f:
        return [tuple(x) for x in json.loads(f.read())]


def directory(f: pa.NativeFile) -> list[zipfile.ZipInfo]:
    """Entries of an archive in the order of their offsets."""
    with zipfile.ZipFile(f) as z:
        return sorted(z.infolist(), key=lambda e: e.header_offset)


def read_member(f: pa.NativeFile, entry: zipfile.ZipInfo) -> bytes:
    """One stored member by its offset, checked against its length and CRC."""
    f.seek(entry.header_offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise OSError(f"no member at {entry.header_offset}")
    name, extra = struct.unpack_from("<HH", head, 26)
    body = f.read(name + extra + entry.compress_size)[name + extra :]
    if len(body) != entry.file_size or zlib.crc32(body) != entry.CRC:
        raise OSError(f"member at {entry.header_offset} is damaged or cut short")
    return body


class _ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.split, self.retries = int(options.get("split", SPLIT)), int(options.get("retries", 3))
        self.lenient = options.get("on_error", "fail") == "null"

    def partitions(self) -> list[_Range]:
        store, folder = _filesystem(self.folder)
        found = manifests(store, folder)
        if not found:
            raise FileNotFoundError(f"no committed archives in {self.folder}")
        files = [x for m in found for x in listed_archives(store, m)]
        cuts = [_Range(name, a, min(a + self.split, size)) for name, size in files for a in range(0, size, self.split)]
        return cuts or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, folder = _filesystem(self.folder)
        path = f"{folder}/{part.path}"
        f = store.open_input_file(path)
        rows: list[tuple] = []
        held = 0
        for entry in directory(f):
            if not part.begin <= entry.header_offset < part.stop:
                continue
            key = entry.filename.partition("/")[2][: -len(".png")]
            media = error = None
            for _ in range(self.retries + 1):
                try:
                    if f.closed:
                        f = store.open_input_file(path)
                    media, error = read_member(f, entry), None
                    break
                except OSError as e:
                    error = str(e)
                    f.close()
            if error and not self.lenient:
                raise OSError(f"{part.path}: {error}")
            rows.append((int(key) if key else None, media, error))
            held += len(media or b"")
            if held >= _BATCH:
                yield self._batch(rows)
                rows, held = [], 0
        f.close()
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, media, errors = zip(*rows, strict=True)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(media, pa.binary()), pa.array(errors, pa.string())], names=["id", "media", "error"])


class MediaArchive(DataSource):
    """``spark.read.format('media_archive').load(folder)`` and the writer beside it."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "id long, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return _ArchiveWriter(self.options, overwrite)


def pack_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "append") -> None:
    """Write each row's text, in UTF-8 and padded, into the archives of a folder; ``mode``: append or overwrite."""
    docs.sparkSession.dataSource.register(MediaArchive)
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs.select(whole_number_ids(docs, id_col).alias("id"), payload.alias("payload")).write.format("media_archive").mode(mode).option("path", folder).save()


def read_media(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Rows (id, media, error) of the archives of a folder."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    for b in batches:
        rows = []
        for media in b.column(1):
            data = media.as_py()
            payload, length = from_png(data)
            rows.append((length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), features(payload)))
        cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True))], names=["doc_id", *kinds])


def media_features(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of every stored payload, from the bytes read back."""
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read_media(spark, folder).select("id", "media").mapInArrow(_measured, kinds)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    folder = fresh_folder(docs.sparkSession, "media")
    pack_media(docs, folder, id_col, text_col)
    return media_features(docs.sparkSession, folder)
