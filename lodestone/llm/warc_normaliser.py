"""WARC archives: writing with revisit records, normalising of monolithic gzip files, reading by offset.

* ``write_monolithic`` writes the records of each task as one gzip stream for a whole file, the
  form in which many archives arrive. Of records with equal payloads the one with the smallest
  id is a ``response``, the others are ``revisit`` records that name it and carry no payload.
* ``normalise`` inflates each such stream once, front to back and in pieces, rewrites every
  record as a gzip member of its own, and writes beside the archive a sidecar index with the
  offset and length of each member, in lines of equal width.
* ``read_records`` deals out runs of ``RUN`` members. A task seeks to its lines of the sidecar,
  which tell where its members are, so a reader starts in the middle of an archive; a large file
  is no longer one task, and no index passes through Spark or the driver.

A file is named by the attempt that wrote it and only files that a successful task reports are
used, so lost executors leave nothing that is read. Memory: one piece of 256 KB of the stream
and one record. Inflating a whole-file stream can't be split; that is why it is done once.

Defined cases: null html is an empty payload; a null id is never referred to; rows with the
smallest id of their payload are all responses, also when the row is repeated; ids must be whole
numbers, others are refused; other columns are left alone; an empty table gives no archives and no
rows. Smaller payloads than ``least`` bytes are always responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.exact_dedup import joined_groups, repeated_plane, with_maybe
from lodestone.llm.storage import fresh_folder, stage, whole_number_ids

PIECE = 256 << 10
RUN = 64
LINE = 32  # bytes of a line of the sidecar: offset, space, length, line feed
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, which states the payload's full length."""
    http = HTTP.format(len(payload)).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(data: bytes) -> dict[str, str]:
    """Named fields of a record head, names in lower case; the first line under ''."""
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0], **{k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}}


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, in order."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 4 + int(parse_head(bytes(held[:at]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends within a record")


def inflated(f) -> Iterator[bytes]:
    """The stream's bytes; members that follow each other are inflated one after the other."""
    engine = zlib.decompressobj(31)
    while data := f.read(PIECE):
        while data:
            yield engine.decompress(data, PIECE)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, PIECE)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)


def parse_record(data: bytes) -> dict:
    """Kind, ids, and the payload's length and digest; a response's are computed and checked."""
    head_end = data.index(b"\r\n\r\n")
    head = parse_head(data[:head_end])
    block = data[head_end + 4 : head_end + 4 + int(head["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    http = parse_head(block[:http_end])
    stated = head["warc-payload-digest"].removeprefix("sha1:")
    kind = head["warc-type"]
    key = lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
    size, digest = int(http["content-length"]), stated
    if kind == "response":
        payload = block[http_end + 4 :]
        size, digest = len(payload), payload_digest(payload)
        if digest != stated:
            raise ValueError(f"{head['warc-record-id']}: the payload doesn't match its digest")
    return {"page_id": key(head["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": key(head["warc-refers-to"]) if kind == "revisit" else None}


def assign_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Rows (page_id, url, html, revisit, refers_to).

    A Bloom filter of the digests tells which payloads may repeat; the rows of all others pass
    without a shuffle. The rest is joined to the smallest id of its digest; the ids are reduced in
    map tasks first, and payloads of very many rows join by a broadcast of bounded size.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    digest = F.unhex(F.sha1(html.cast("binary")))
    rows = pages.select(whole_number_ids(pages, id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), digest.alias("__digest"))
    sized = F.octet_length("html") >= least
    every = pages.count()
    plane, words = repeated_plane(rows.select("__digest"), every)
    tested = with_maybe(rows, plane, words)
    plain = tested.where(~(F.col("__maybe") & sized)).select("page_id", "url", "html", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to"))
    maybe = tested.where(F.col("__maybe") & sized)
    groups = stage(maybe.groupBy("__digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "warc-payloads")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    settled = joined_groups(maybe, groups, "n", every).select("page_id", "url", "html", again.alias("revisit"), F.when(again, F.col("first")).alias("refers_to"))
    return plain.unionByName(settled)


def write_monolithic(typed: DataFrame, folder: str) -> DataFrame:
    """One gzip stream for each task. Returns the staged list of files (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _filesystem(folder)
        store.create_dir(at, recursive=True)
        name, n, out = f"mono-{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            for row in range(b.num_rows):
                page, url, html, revisit, refers = (c[row].as_py() for c in b.columns)
                if out is None:
                    raw = store.open_output_stream(f"{at}/{name}", compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=4, mtime=0)
                out.write(record_bytes(page, url, html.encode(), refers, revisit))
                n += 1
        if out is not None:
            out.close()
            raw.close()
            yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], names=["name", "records"])

    return stage(typed.mapInArrow(run, "name string, records long"), "warc-files")


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive with a member for each record. Returns the staged list of archives (name, members).

    The sidecar ``<name>.idx`` beside each archive has a line of ``LINE`` bytes for each member. The
    monolithic files go when all archives are complete.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, here = _filesystem(source)
        _, there = _filesystem(target)
        store.create_dir(there, recursive=True)
        for b in batches:
            for mono in b.column(0).to_pylist():
                name, at, n = f"norm-{uuid.uuid4().hex}.warc.gz", 0, 0
                with (
                    store.open_input_stream(f"{here}/{mono}", compression=None) as f,
                    store.open_output_stream(f"{there}/{name}", compression=None) as out,
                    store.open_output_stream(f"{there}/{name}.idx", compression=None) as side,
                ):
                    for record in records(inflated(f)):
                        member = gzip.compress(record, 4, mtime=0)
                        out.write(member)
                        side.write(b"%018d %012d\n" % (at, len(member)))
                        at += len(member)
                        n += 1
                yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], names=["name", "members"])

    spark = files.sparkSession
    dealt = files.select("name").repartitionByRange(max(1, files.count()), "name")
    archives = stage(dealt.mapInArrow(run, "name string, members long"), "warc-archives")
    _delete(spark, source)
    return archives


def sidecar_lines(side, first: int, n: int) -> list[tuple[int, int]]:
    """(offset, length) of ``n`` members from the ``first`` on, from an open sidecar."""
    side.seek(first * LINE)
    data = side.read(n * LINE)
    if len(data) != n * LINE or data[LINE - 1 :: LINE] != b"\n" * n:
        raise ValueError("the sidecar is cut short or damaged")
    return [(int(data[a : a + 18]), int(data[a + 19 : a + 31])) for a in range(0, len(data), LINE)]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives (name, members).

    Runs of ``RUN`` members are dealt out by archive and first member; offsets come from the sidecars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _filesystem(folder)
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        for b in batches:
            for name, first, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_file(f"{at}/{name}.idx") as side, store.open_input_file(f"{at}/{name}") as f:
                    got = []
                    for offset, length in sidecar_lines(side, first, n):
                        f.seek(offset)
                        got.append(parse_record(gzip.decompress(f.read(length))))
                yield pa.record_batch([pa.array([g[k] for g in got], t) for k, t in kinds.items()], names=list(kinds))

    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("members") - 1, F.lit(RUN).cast("long"))).alias("first")
    runs = archives.where("members > 0").select("name", "members", first)
    runs = runs.select("name", "first", F.least(F.lit(RUN).cast("long"), F.col("members") - F.col("first")).alias("n"))
    dealt = runs.repartition(F.col("name"), F.col("first"))
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages, normalise the archives, and read every record back."""
    spark = pages.sparkSession
    mono, norm = fresh_folder(spark, "warc-mono"), fresh_folder(spark, "warc-norm")
    files = write_monolithic(assign_types(pages, least=least), mono)
    return read_records(normalise(files, mono, norm), norm)
